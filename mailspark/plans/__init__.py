"""Workflows composed from the operators: ingest, search, message view, reports."""
