"""Counting distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.session import stage

# Hashes of repeated rows that are sent to all tasks, packed by so many into a row: 40 MB.
SUSPECTS, _PACKED = 1 << 22, 64
# Distinct aggregates in one query: each adds one copy of a row before its partial aggregation.
_BATCH = 16


def distinct_counts(df: DataFrame, values: dict[str, Column], approximate: bool = False) -> dict[str, int]:
    """Number of different non-null values of each expression, a batch of columns per scan."""
    names = list(values)
    counter = F.approx_count_distinct if approximate else F.count_distinct
    found: dict[str, int] = {}
    size = len(names) if approximate else _BATCH
    for start in range(0, len(names), size or 1):
        batch = names[start : start + size]
        row = df.agg(*[counter(values[n]).alias(f"d{i}") for i, n in enumerate(batch)]).first()
        found.update({n: row[f"d{i}"] for i, n in enumerate(batch)})
    return found


def small_cardinalities(df: DataFrame, values: dict[str, Column], bound: int) -> dict[str, int]:
    """Exact distinct counts up to ``bound``; anything larger is reported as ``bound + 1``.

    A sketch estimate far above the bound proves that the bound is passed (few values touch few
    registers), so only columns of small cardinality are counted exactly, and those combine on the
    map side. Wide columns are never shuffled for a threshold test.
    """
    estimate = distinct_counts(df, values, approximate=True)
    close = {n: values[n] for n in values if estimate[n] <= 2 * bound + 10}
    exact = distinct_counts(df, close)
    return {n: min(exact.get(n, bound + 1), bound + 1) for n in values}


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def part_suspects(df: DataFrame, bound: int = SUSPECTS) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows that certainly equal no other, and rows that may: those whose 64-bit hash occurs more than once.

    Only hashes are shuffled for this, 8 bytes a row. The repeated ones are counted and sent to all tasks if they are at
    most ``bound``, so that unique rows stay where they are and the suspects, which are staged, alone are shuffled. Beyond that
    many repeats all rows are suspects and there is no first part. A false suspect costs its shuffle, nothing else.
    """
    if not df.columns:
        return None, df
    hashed = df.select(row_hash(df).alias("hash"))
    repeated = stage(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "repeated")
    found = repeated.count()
    if found > bound:
        return None, df
    if not found:
        return df, None
    buckets = F.lit(found // _PACKED + 1)
    packed = repeated.groupBy(F.pmod("hash", buckets).alias("bucket")).agg(F.collect_list("hash").alias("hashes"))
    same = (F.pmod(row_hash(df), buckets) == packed["bucket"]) & F.array_contains(packed["hashes"], row_hash(df))
    small = F.broadcast(packed)
    return df.join(small, same, "left_anti"), stage(df.join(small, same, "left_semi"), "suspects")


def extra_rows(suspects: DataFrame) -> DataFrame:
    """The rows that occur more than once, each once, and in ``__extra`` how often beyond the first."""
    counted = suspects.groupBy(*[F.col("`" + c.replace("`", "``") + "`") for c in suspects.columns]).agg((F.count(F.lit(1)) - 1).alias("__extra"))
    return counted.filter("__extra > 0")


def duplicate_rows(df: DataFrame, parts: tuple[DataFrame | None, DataFrame | None] | None = None) -> int:
    """Rows beyond the first of each group of equal rows; whole rows are compared only where their hashes repeat.

    A caller that has them already passes the ``parts`` of ``part_suspects``.
    """
    _, suspects = parts or part_suspects(df)
    if suspects is None:
        return 0
    return extra_rows(suspects).agg(F.sum("__extra").alias("extra")).first()["extra"] or 0
