"""Readers and writers of annotations, tokens, tuples and graphs."""
