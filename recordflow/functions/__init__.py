"""Scalar functions of the expression language, as Column builders."""

from .registry import FUNCTIONS, GENERATORS, STRINGS

__all__ = ["FUNCTIONS", "GENERATORS", "STRINGS"]
