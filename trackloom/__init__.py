"""Spark-first analytics over dense tracking annotations, plus corpus tooling in ``trackloom.llm``."""
