"""Readers and writers of the document and table formats."""
