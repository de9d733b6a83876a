"""Readers and writers for the flat-file forms of listings."""
