"""Expressions as DataFrame plans."""

from .compiler import apply
from .slurp import slurp

__all__ = ["apply", "slurp"]
