"""Relational operators over record streams."""

from .edits import edit, merge_objects
from .joins import anti, asof_join, join, overlap_join, range_join, semi, theta_join
from .profile import analyze, inspect_schema
from .streams import head, merge, numbered, tail

__all__ = ["analyze", "anti", "asof_join", "edit", "head", "inspect_schema", "join", "merge", "merge_objects", "numbered", "overlap_join", "range_join", "semi", "tail", "theta_join"]
