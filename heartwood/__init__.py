"""Incremental, hierarchical refresh of derived documents on Spark."""
