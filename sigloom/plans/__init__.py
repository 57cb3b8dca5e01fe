"""Dictionaries, pipelines and the query registry."""
