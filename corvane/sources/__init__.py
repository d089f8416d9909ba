"""Readers of the supported source formats and writers of the artifacts."""
