"""Readers of documents, cases and stored results; writers of results."""
