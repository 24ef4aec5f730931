"""Readers and writers: delimited files, feature tables, online rows."""
