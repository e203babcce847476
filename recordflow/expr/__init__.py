"""A small path-expression language over records: parser and tree."""

from .parser import ExpressionError, parse

__all__ = ["ExpressionError", "parse"]
