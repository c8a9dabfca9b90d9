"""tidemark: feature engineering and model monitoring as plain PySpark DataFrame code."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks are shipped with the job, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
