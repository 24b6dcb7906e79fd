"""Operators for building training corpora, each as Spark jobs."""
