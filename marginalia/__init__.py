"""Marginalia: a Spark-first engine for note, web and review-record corpora."""
