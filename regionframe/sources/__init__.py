"""Readers, writers and the repository of datasets."""
