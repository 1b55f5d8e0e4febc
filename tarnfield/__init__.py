"""Tarnfield: a Spark-first engine for screening, selecting and searching text corpora."""
