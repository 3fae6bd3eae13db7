"""The corpus pipeline: documents to sampled token ids. Its stages are part of the training-data package."""

from tessera.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
