"""Named queries over the driver tables and their SQL oracles.

Importing this package registers every query module."""

from . import (corpus_queries, extract_queries, io_queries, lexicon_queries,  # noqa: F401
               model_queries, scoring_queries)
from .registry import OPERATOR_IDS, ORACLES, QUERIES  # noqa: F401
