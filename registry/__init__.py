"""Every operator as a named query over the test tables, with its SQL counterpart."""

from . import catalog, features, files, names, privacy, profiling, text  # noqa: F401
from .base import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
