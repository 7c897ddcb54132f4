"""Span analytics over clinical and other free text, written as Spark plans."""
