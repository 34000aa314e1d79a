"""Lowering of paths to native Spark columns where that is exactly equivalent."""

from .lower import Typed, declared, json_value, lowerable

__all__ = ["Typed", "declared", "json_value", "lowerable"]
