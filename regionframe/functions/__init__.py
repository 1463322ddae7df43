"""Expressions, predicates and aggregates as Spark columns."""
