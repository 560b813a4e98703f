"""Streams of nodes: the same aggregates, kept up to date as rows arrive."""
