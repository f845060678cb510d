"""Cutting lineage and size checks used before broadcasting."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelink.session import ensure_checkpoint_dir


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """In it, Spark removes a job's shuffle files as soon as its result is written, not when the driver
    happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """``df``, written, with the place of each row (from 0) in the order of these columns.

    No task sees all rows: ranges are sorted side by side, and each starts where the ones before
    it end. The driver holds one count per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(df.sparkSession):
        own = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        own = checkpointed(own)
        part = F.shiftright("_at", 33)
        counts = own.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    first, total = [], 0
    for r in counts:
        first += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    start = F.element_at(F.create_map(*first), part) if first else F.lit(0)
    return own.withColumn(name, (start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def broadcast_limit(spark) -> int:
    """The session's own auto-broadcast threshold; a side is broadcast only when it is measured smaller."""
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        limit = int(str(conf).lower().rstrip("b"))
    except ValueError:
        limit = 10485760
    return max(limit, 0)


def measured_bytes(df: DataFrame) -> tuple[int, int]:
    """Row count and an upper estimate of the bytes of ``df`` (one small job)."""
    width = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t == "string":
            width.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 8)
        else:
            width.append(F.lit(16))
    total = width[0]
    for w in width[1:]:
        total = total + w
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def maybe_broadcast(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(df), True)`` when its measured size fits, else ``(df, False)``.

    ``df`` should be materialised (``checkpointed``) first so the measurement
    does not recompute its lineage.
    """
    limit = broadcast_limit(df.sparkSession) if limit is None else limit
    _, nbytes = measured_bytes(df)
    if nbytes <= limit:
        return F.broadcast(df), True
    return df, False


def with_constants(df: DataFrame, consts: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``consts`` (one row per key; null keys match null).

    An equi-join that Spark broadcasts while the table is small; there is no limit on the number of keys.
    """
    right = consts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in consts.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(right, on, "left").drop(*[f"_k_{k}" for k in keys])
