"""The corpus pipeline: STAGES over documents, and run() for all of them."""

from warraq.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
