"""Scans, sinks and inline lookup tables."""

from .lookups import lookup_df, lookup_value, season_of
from .tables import load_table, read_table, save_table, write_csv

__all__ = ["lookup_df", "lookup_value", "season_of", "load_table", "read_table", "save_table", "write_csv"]
