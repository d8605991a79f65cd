"""Logistics event analytics expressed as Spark DataFrame transformations."""

from haulscope.model.params import Params

__all__ = ["Params"]
