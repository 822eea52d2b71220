"""Stages, the question façade and the query registry."""
