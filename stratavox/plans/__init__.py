"""Registered queries with their SQL forms, and whole pipelines."""
