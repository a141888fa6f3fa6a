"""The corpus pipeline: documents in, token ids out. Its stages are in tallyspark.llm.stages."""

from tallyspark.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
