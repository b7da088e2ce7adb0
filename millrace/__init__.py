"""Millrace: retrieval, log and corpus analytics as plain Spark DataFrame functions."""
