"""The corpus pipeline as a registered query."""

import corpus_pipeline

QUERIES = {"pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}
