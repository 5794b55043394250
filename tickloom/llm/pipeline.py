"""From documents to token ids: the stages of the corpus pipeline, each one operator over all that came before.

A stage takes (spark, docs, sf_dir) and returns the documents that go on; the last returns one row for each document
of the mix. Between stages the rows are written as Parquet and read again.

Defined results, for every stage: an empty table gives no rows; columns other than those of documents are left out; a
null in any column but text is a value like another. A null or empty text is rejected by the quality stage, and passes
any later stage that it is given to (line_dedup leaves it as it is, it links with nothing, and encodes to no tokens).
Repeated rows (same id and text) fare alike until near_duplicates, which keeps one of them; rows with one id and
different texts are different documents. Very long texts go through whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, jaccard, kneser_ney, lines, mixing
from tickloom.llm.queries import BYTE_BPE, trusted_ids
from tickloom.session import cut, importable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is in their language's range of trusted text."""
    return kneser_ney.keep(docs.select(*COLUMNS), trusted_ids(spark, sf_dir)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; one that lost its last line goes."""
    left = lines.dedup(docs.select(*COLUMNS)).where("n_removed = 0 OR length(text) > 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with alike shingles."""
    importable(spark)
    return jaccard.dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight says, shuffled."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, told by count and digests."""
    importable(spark)
    return bpe.round_trip(docs, BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_stage),
    ("tokens", tokens),
]

#: Iterated counts and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
