"""Readers and writers of the domain's text formats."""
