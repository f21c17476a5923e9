"""Readers and writers: feeds, sitemaps, REST pages, books, plug-ins, sinks."""
