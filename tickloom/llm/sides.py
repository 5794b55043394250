"""Joining rows to a side table whose size is not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side table is broadcast, and parts over which a key is spread beyond that.
BROADCAST_ROWS, SALTS = 1_000_000, 32


def attach(rows: DataFrame, side: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` left-joined to `side` (one row per key, null is a key), which is broadcast if it has at most `most` rows.

    Beyond that the side is repeated for each salt and rows are spread over the salts, so a hot key is no hot task. The salt is a hash of the row,
    so a task that runs again deals its rows out alike.
    """
    named = side.withColumnRenamed(key, "_side_key")
    if side.count() <= most:
        return rows.join(F.broadcast(named), rows[key].eqNullSafe(named["_side_key"]), "left").drop("_side_key")
    salted = named.withColumn("_side_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    plain = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    on = spread[key].eqNullSafe(salted["_side_key"]) & (spread["_salt"] == salted["_side_salt"])
    return spread.join(salted, on, "left").drop("_side_key", "_side_salt", "_salt")
