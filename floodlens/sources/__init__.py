"""Readers, envelopes, normalisers and sinks."""
