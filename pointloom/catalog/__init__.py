"""Registered queries over the driver tables."""

from pointloom.catalog import client, observations, spatial, tables, times
from pointloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "client", "observations", "spatial", "tables", "times"]
