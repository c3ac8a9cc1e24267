"""Spark-native analytics for hierarchical structures: tables, selections, fields, grids, frames."""
