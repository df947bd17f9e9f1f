"""Queries over the driver's tables and the SQL that they are checked against."""

from lodestone.plans import corpus, formats, metrics, models, retrieval, texts, training
from lodestone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "formats", "metrics", "models", "retrieval", "texts", "training"]
