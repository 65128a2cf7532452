"""The corpus pipeline: STAGES in order, each a function of (spark, docs, sf_dir); run() applies them to documents.

SQL can't express the stages on toxicity and tokens, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from provenloom.llm.pipeline import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
