"""Environmental-risk analytics expressed as Spark DataFrames.

Layout
------
functions/  column expressions (risk index, JSON scalars, text, geometry, tide model)
operators/  DataFrame -> DataFrame operators (latest, as-of, nearest, scoring, payload shapes)
sources/    readers, envelopes, per-source normalisers and sinks
streaming/  Structured Streaming landing, scoring and windowed jobs
plans/      input views and the registry of queries with their SQL twins
"""
