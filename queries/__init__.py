"""Registered queries: one Spark callable per operator, with its check SQL where one exists."""

import sys

from pyspark import cloudpickle

from .base import QUERIES, SQL  # noqa: F401
from . import (  # noqa: F401
    documents, evaluation, features, joins, monitoring, projections, sources, statistics,
    streams, windows,
)

# Models and applications defined here run inside tasks: ship them with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
