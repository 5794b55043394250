"""The corpus pipeline: STAGES, run and ORACLE_SQL. The stages are in the corpus subpackage, of which this is a part."""

from tickloom.llm.pipeline import ORACLE_SQL, STAGES, oracle_sql, queries, run

__all__ = ["ORACLE_SQL", "STAGES", "oracle_sql", "queries", "run"]
