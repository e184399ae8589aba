"""Imports every query module, which registers the queries."""

from clickforge.plans import embeddings, etl, evaluation, graphs, profiling, runs, sequences, streams  # noqa: F401
