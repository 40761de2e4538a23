"""Immutable entity-attribute-value facts, queried with Datalog, on Spark."""
