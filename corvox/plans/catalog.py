"""Imports every module of queries, so that the registry is complete."""

from . import catalogs, records, scalars, volumes  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
