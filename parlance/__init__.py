"""Spark-first analytics for speech-like corpora and event timelines."""
