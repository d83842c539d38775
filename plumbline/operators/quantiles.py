"""Exact quantiles without gathering a column in one place.

``percentile`` keeps a map of all distinct values, so it serves only where their number is bounded.
Otherwise the wanted rank is bracketed first: a quantile sketch of a row sample proposes an interval
around the rank, the next pass counts exactly what lies below and inside it, and only once few
distinct values are left inside do they reach ``percentile``. An interval that misses its rank is
rejected by the count, so sampling affects the number of passes, never the result. Every pass is a
partial aggregation; no row is shuffled and no state grows with the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Distinct values that one aggregation buffer, and all buffers of one pass, may hold.
DISTINCT_LIMIT = 200_000
PASS_LIMIT = 2_000_000
# Rows of one group that a single task may sort (it spills; only its time is bounded by this).
GROUP_LIMIT = 2_000_000

# Sketch: a grid of 0.5 % cells from about 200,000 sampled rows. Their sampling error is 0.11 % at
# most, so a margin of two cells misses the rank practically never.
_CELLS = 200
_MARGIN = 2
_SAMPLE = 200_000
_GRID = [i / _CELLS for i in range(_CELLS + 1)]
_ACCURACY = 2_000


@dataclass
class Quantiles:
    """Non-null count and the requested quantiles (None for a column without values)."""

    count: int
    values: list[float | None]


@dataclass
class _Bracket:
    """An interval known to hold the order statistics around one rank."""

    position: float  # fractional rank in the whole column, from 0
    low: float
    high: float
    below: int  # values under ``low``
    inside: int  # values in [low, high]
    distinct: float  # upper bound, inside
    grid: list[float] = field(default_factory=list)
    margin: int = _MARGIN

    def open(self, limit: int) -> bool:
        return self.distinct > limit and self.low < self.high

    def proposal(self) -> tuple[float, float]:
        """The grid cells around the rank, with a margin on either side."""
        if not self.grid:
            return self.low, self.high
        share = (self.position - self.below) / max(1, self.inside - 1) * _CELLS
        first, last = math.floor(share) - self.margin, math.ceil(share) + self.margin
        return (
            self.low if first <= 0 else self.grid[first],
            self.high if last >= _CELLS else self.grid[last],
        )

    def sample_share(self) -> float:
        return min(1.0, _SAMPLE / max(1, self.inside))

    def settle(self, low: float, high: float, seen: dict) -> None:
        """Take over the counted interval if it holds the rank, else ask for a wider margin.

        Ties at either end are cut off where the rank lies beyond them, so that one very frequent
        value cannot stop the narrowing.
        """
        below, inside = seen["below"], seen["inside"]
        if not (below <= math.floor(self.position) and math.ceil(self.position) < below + inside):
            self.margin *= 4
            return
        if seen["next_low"] is not None and math.floor(self.position) >= below + seen["ties_low"]:
            low, below, inside = seen["next_low"], below + seen["ties_low"], inside - seen["ties_low"]
        if seen["prev_high"] is not None and math.ceil(self.position) < below + inside - seen["ties_high"]:
            high, inside = seen["prev_high"], inside - seen["ties_high"]
        self.low, self.high, self.below, self.inside = low, high, below, inside
        self.distinct, self.grid, self.margin = min(inside, seen["rows"]), [], _MARGIN

    def share_inside(self) -> float:
        return min(1.0, max(0.0, (self.position - self.below) / max(1, self.inside - 1)))


def _interval_figures(v: Column, low: Column, high: Column, weight: Column) -> dict[str, Column]:
    """Exact counts around an interval, in one aggregation."""
    inside = F.when(v.between(low, high), v)
    counted = lambda condition: F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))
    return {
        "below": counted(v < low),
        "inside": counted(v.between(low, high)),
        "ties_low": counted(v == low),
        "ties_high": counted(v == high),
        "next_low": F.min(F.when(v > low, inside)),
        "prev_high": F.max(F.when(v < high, inside)),
        "rows": F.count(inside),
    }


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: list[float],
    limit: int = DISTINCT_LIMIT,
    weight: Column | None = None,
    known: dict[str, tuple[int, int]] | None = None,
) -> dict[str, Quantiles]:
    """Linearly interpolated quantiles of numeric expressions over all rows of ``df``.

    With ``weight``, each row stands for that many equal rows (a value distribution). A caller that
    has counted already passes ``known``: values, and at most how many distinct ones, per expression.
    """
    if not values:
        return {}
    names = list(values)
    data = df.select(
        *[values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)],
        (F.lit(1) if weight is None else weight).cast("bigint").alias("w"),
        F.rand(42).alias("draw"),
    )
    column = {n: F.col(f"v{i}") for i, n in enumerate(names)}

    if known is None:
        first = data.agg(
            *[F.sum(F.when(c.isNotNull(), F.col("w"))).alias(f"n{i}") for i, c in enumerate(column.values())],
            *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(column.values())],
        ).first()
        known = {n: (first[f"n{i}"] or 0, first[f"d{i}"]) for i, n in enumerate(names)}
    result = {n: Quantiles(known[n][0], [None] * len(probs)) for n in names}
    # The distinct estimate errs by a few percent; half the limit leaves it ample room.
    limit = min(limit, PASS_LIMIT // (len(names) * len(probs))) // 2
    brackets = {
        (n, p): _Bracket(p * (result[n].count - 1), -math.inf, math.inf, 0, result[n].count, known[n][1])
        for n in names
        for p in probs
        if result[n].count
    }

    while keys := [k for k, b in brackets.items() if b.open(limit)]:
        _propose(data, column, [(k, brackets[k]) for k in keys if not brackets[k].grid])
        exprs = []
        for i, k in enumerate(keys):
            low, high = (F.lit(x) for x in brackets[k].proposal())
            figures = _interval_figures(column[k[0]], low, high, F.col("w"))
            exprs += [e.alias(f"{name}{i}") for name, e in figures.items()]
        row = data.agg(*exprs).first().asDict()
        for i, k in enumerate(keys):
            low, high = brackets[k].proposal()
            brackets[k].settle(low, high, {name: row[f"{name}{i}"] for name in figures})

    # One ``percentile`` per (column, interval), over the interval's values only.
    groups: dict[tuple, list] = {}
    for (n, p), b in brackets.items():
        groups.setdefault((n, b.low, b.high), []).append((p, b))
    exprs = []
    for i, ((n, low, high), members) in enumerate(groups.items()):
        v = column[n]
        inside = v if (low, high) == (-math.inf, math.inf) else F.when(v.between(F.lit(low), F.lit(high)), v)
        shares = F.array(*[F.lit(b.share_inside()) for _, b in members])
        exprs.append((F.percentile(inside, shares, F.col("w"))).alias(f"q{i}"))
    if exprs:
        row = data.agg(*exprs).first()
        for i, ((n, _, _), members) in enumerate(groups.items()):
            for (p, _), value in zip(members, row[f"q{i}"]):
                for j, wanted in enumerate(probs):
                    if wanted == p:
                        result[n].values[j] = value
    return result


def first_rows(df: DataFrame, order: list[Column], wanted: int) -> tuple[Column, list[float]]:
    """A condition that holds for the ``wanted`` first rows by ascending numbers without nulls, and the cut of each number used.

    The cut lies halfway between the last wanted number and the next, which tells ties: only rows at the cut itself
    go on to the next number. Rows equal in all numbers are taken or left together.
    """
    first, tied, cuts = F.lit(False), F.lit(True), []
    for key in order:
        rows = df.filter(tied)
        n = rows.count()
        share = min(1.0, max(0.0, (wanted - 0.5) / max(1, n - 1)))
        cut = exact_quantiles(rows, {"key": key}, [share])["key"].values[0]
        cuts.append(cut)
        seen = rows.agg(F.count_if(key < F.lit(cut)).alias("below"), F.count_if(key == F.lit(cut)).alias("at")).first()
        first, tied = first | (tied & (key < F.lit(cut))), tied & (key == F.lit(cut))
        wanted -= seen["below"]
        if not 0 < wanted < seen["at"]:
            break
    return first | tied if wanted > 0 else first, cuts


def _propose(data: DataFrame, column: dict[str, Column], brackets: list) -> None:
    """Give each bracket a grid: quantiles of a row sample of its interval, drawn by weight."""
    unique: dict[tuple, list[_Bracket]] = {}
    for (n, _), b in brackets:
        unique.setdefault((n, b.low, b.high), []).append(b)
    if not unique:
        return
    entries = []
    for i, ((n, low, high), members) in enumerate(unique.items()):
        v = column[n]
        copies = F.floor(F.col("w") * F.lit(members[0].sample_share()) + F.col("draw"))
        inside = v.between(F.lit(low), F.lit(high))
        entries.append(F.struct(F.lit(i).alias("i"), v.alias("v"), F.when(inside, copies).alias("copies")))
    sample = data.select(F.inline(F.array(*entries))).filter("copies > 0")
    sample = sample.select("i", "v", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    grids = sample.groupBy("i").agg(F.percentile_approx("v", _GRID, _ACCURACY).alias("grid")).collect()
    found = {r["i"]: list(r["grid"]) for r in grids}
    for i, members in enumerate(unique.values()):
        for b in members:
            b.grid = found.get(i) or [b.low] * _CELLS + [b.high]


def grouped_median(
    df: DataFrame, by: list[str], value: Column, name: str = "median", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Exact median of ``value`` per group: columns ``by`` and ``name``.

    Equal values combine before the shuffle and a running count finds the middle ranks. A group of
    more than ``limit`` rows would be one task's sort, so its bracket is narrowed first; there are at
    most rows/limit such groups, and their bracket table is broadcast.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    data = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], value.cast("double").alias("__v"))
    data = data.filter(F.col("__v").isNotNull())
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.filter(F.col("__n") > limit).collect()

    state = {
        tuple(r[k] for k in keys): _Bracket((r["__n"] - 1) / 2, -math.inf, math.inf, 0, r["__n"], math.inf)
        for r in hot
    }
    spark = df.sparkSession
    key_fields = [T.StructField(f"__b{i}", sizes.schema[k].dataType) for i, k in enumerate(keys)]
    double, long = T.DoubleType(), T.LongType()

    def table(rows, **columns):
        schema = T.StructType(key_fields + [T.StructField(c, t) for c, t in columns.items()])
        # One row per group of more than ``limit`` rows; unhinted, Spark would shuffle all rows to a few tasks.
        return F.broadcast(spark.createDataFrame(rows, schema))

    def same_group(right_keys):
        condition = F.lit(True)
        for k, other in zip(keys, right_keys):
            condition = condition & F.col(k).eqNullSafe(F.col(other))
        return condition

    bracket_keys = [f"__b{i}" for i in range(len(keys))]
    v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
    while open_keys := [k for k, b in state.items() if b.open(limit // 2)]:
        fresh = [k for k in open_keys if not state[k].grid]
        if fresh:
            spans = table(
                [(*k, state[k].low, state[k].high, state[k].sample_share()) for k in fresh],
                __low=double, __high=double, __share=double,
            )
            sample = data.join(spans, same_group(bracket_keys)).filter(
                v.between(low, high) & (F.rand(42) < F.col("__share"))
            )
            grids = sample.groupBy(*bracket_keys).agg(F.percentile_approx(v, _GRID, _ACCURACY).alias("grid"))
            for r in grids.collect():
                state[tuple(r[b] for b in bracket_keys)].grid = list(r["grid"])
        spans = table([(*k, *state[k].proposal()) for k in open_keys], __low=double, __high=double)
        figures = _interval_figures(v, low, high, F.lit(1))
        rows = (
            data.join(spans, same_group(bracket_keys))
            .groupBy(*bracket_keys, "__low", "__high")
            .agg(*[e.alias(name) for name, e in figures.items()])
            .collect()
        )
        for r in rows:
            state[tuple(r[b] for b in bracket_keys)].settle(r["__low"], r["__high"], r.asDict())

    if state:
        intervals = table(
            [(*k, b.low, b.high, b.below) for k, b in state.items()], __low=double, __high=double, __below=long
        )
        data = data.join(intervals, same_group(bracket_keys), "left").filter(
            F.col("__low").isNull() | F.col("__v").between(F.col("__low"), F.col("__high"))
        )
        below = F.coalesce(F.max("__below"), F.lit(0))
    else:
        below = F.lit(0)

    counted = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"), below.alias("__below"))
    running = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("__end", F.sum("__c").over(running) + F.col("__below"))
    # A value is in the middle where the ranks it fills, [end - count, end), hold one of the middle ranks.
    ranked = ranked.join(
        sizes.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], "__n"),
        same_group([f"__s{i}" for i in range(len(keys))]),
    )
    start, end = F.col("__end") - F.col("__c"), F.col("__end")
    holds = lambda rank: F.max(F.when((start <= rank) & (rank < end), F.col("__v")))
    lower = F.floor((F.col("__n") - 1) / 2)
    upper = F.floor(F.col("__n") / 2)
    median = (holds(lower) + holds(upper)) / 2
    return ranked.groupBy(*keys).agg(median.alias(name)).select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)], name
    )
