"""Interval analytics on PySpark DataFrames."""

from regionframe.model import Dataset

__all__ = ["Dataset"]
