"""A reading archive as DataFrames: sources, dates, merging, queues, and corpus preparation."""
