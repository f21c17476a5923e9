"""Registered queries over views of the test tables, with their SQL twins."""
