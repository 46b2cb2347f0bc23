"""Corpus queries and the SQL some of them are checked against."""

import corpus_pipeline
from logfathom.llm import oracles, queries

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLES = oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
