"""Operators for training-data corpora: mixing, near-duplicates, licences, pages, models, tokens.

Nothing else in the library imports this subpackage; its registered queries are in
``tidemark.llm.queries``.  Task functions travel with the job (see ``tidemark``), so workers
need numpy, pandas, pyarrow and, where an operator says so, a tokenizer file only.
"""
