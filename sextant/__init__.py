"""Retrieval, measurement and answer-quality analytics as DataFrame transformations."""
