"""Readers and writers: delimited and tuple text, routed output, table specs, catalog tables."""
