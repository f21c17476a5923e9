"""Operators for preparing large text corpora: mixing, filtering, de-duplication, formatting."""
