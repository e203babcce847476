"""Readers."""

from .load import inspect_profile, load, load_profile, with_lineage
from .records import register as register_records
from .tables import container, table

__all__ = ["container", "inspect_profile", "load", "load_profile", "register_records", "table", "with_lineage"]
