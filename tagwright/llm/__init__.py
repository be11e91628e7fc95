"""Training-data pipeline operators (one module per operator) and their
registered queries. Nothing else in the library imports this package.

``QUERIES`` and ``ORACLES`` are filled by :mod:`tagwright.llm.queries`.
"""

from .queries import ORACLES, QUERIES  # noqa: F401
