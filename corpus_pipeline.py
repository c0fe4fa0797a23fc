"""The pipeline over documents: each stage takes what its predecessor kept."""
from plateaux.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
