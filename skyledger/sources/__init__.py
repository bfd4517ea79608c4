"""Readers, writers, schemas and feed decoders."""
