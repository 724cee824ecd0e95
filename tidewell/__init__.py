"""Spark jobs over the data that agent platforms produce: tables, run events, memory, text corpora, evaluations."""
