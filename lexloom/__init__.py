"""Lexloom: corpus retrieval, retrieval evaluation and data preparation on Spark."""
