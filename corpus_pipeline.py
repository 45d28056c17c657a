"""The corpus pipeline: five operators in a row, each on what the one before it kept."""

from __future__ import annotations

from folio.llm.stages import STAGES, run

ORACLE_SQL = None
__all__ = ["ORACLE_SQL", "STAGES", "run"]
