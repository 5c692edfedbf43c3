"""Spark-first analytics over dated panels, score paths and time-weighted second-moment operators."""
