"""Structured Streaming: new contigs into a sketch database."""
