"""Pipelines over modalities, and the registered queries."""
