"""Spark-first analytics engine for structure, docking and trajectory tables."""
