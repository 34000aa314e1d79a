"""JSONPath: parsing, rewriting, evaluation."""

from .parser import PathError, parse
from .rewrite import Compiled, compile_path

__all__ = ["Compiled", "PathError", "compile_path", "parse"]
