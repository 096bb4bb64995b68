"""Joins of points with the half-open intervals [begins, ends) that hold them, by a sweep over starts and ends.

The events of all keys are dealt by ranges of (key, time) and numbered: an interval then covers the points of its key whose
numbers lie between those of its two ends. Candidates are what the times allow and nothing else, however many rows a key
has, and a hot key is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.storage import stored

#: Numbers of points that meet intervals in one group of the join.
BLOCK = 32
#: Rows of a key up to which each meets each: below that a sweep costs more than it saves.
FEW = 1_000
_END, _BEGIN, _POINT = 0, 1, 2


def _numbered(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``events(keys, t, kind, row)`` with ``n``: the points before each in the order of all columns.

    Ranges are written with their numbers; what stands before a range is a sum over one row a range.
    """
    order = [*keys, "t", "kind", "row"]
    dealt = stored(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sweep")
    is_point = (F.col("kind") == _POINT).cast("long")
    sums = dealt.groupBy("part").agg(F.sum(is_point).alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("before") + F.coalesce(F.sum(is_point).over(inside), F.lit(0))
    return dealt.join(stored(before, "sweep-ranges"), "part").withColumn("n", n)


def points_in_intervals(intervals: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(interval, point): the row ids of ``intervals(keys, row, begins, ends)`` and ``points(keys, row, t)`` with equal keys
    and begins <= t < ends.

    A null end is open. Rows with a null key, begin or time meet nothing, as in any join.
    """
    intervals, points = intervals.dropna(subset=[*keys, "begins"]), points.dropna(subset=[*keys, "t"])
    ends = F.coalesce("ends", F.lit("9999-12-31 23:59:59").cast("timestamp"))
    side = lambda t, kind: F.struct(t.alias("t"), F.lit(kind).alias("kind"))
    both = intervals.select(*keys, F.explode(F.array(side(F.col("begins"), _BEGIN), side(ends, _END))).alias("e"), "row").select(*keys, "e.t", "e.kind", "row")
    n = _numbered(both.unionByName(points.select(*keys, "t", F.lit(_POINT).alias("kind"), "row")), keys)
    n = stored(n.select("kind", "row", "n"), "sweep-numbers")
    spans = n.filter(F.col("kind") != _POINT).groupBy("row").agg(F.max(F.when(F.col("kind") == _BEGIN, F.col("n"))).alias("lo"), F.max(F.when(F.col("kind") == _END, F.col("n"))).alias("hi"))
    spans = spans.filter("lo < hi").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))))
    at = n.filter(F.col("kind") == _POINT).select(F.col("row").alias("point"), "n", F.floor(F.col("n") / BLOCK).alias("block"))
    return spans.hint("merge").join(at, "block").filter("n >= lo and n < hi").select(F.col("row").alias("interval"), "point")


def self_overlaps(spans: DataFrame, keys: Sequence[str], ident: str, few: int = FEW) -> DataFrame:
    """(a, b): pairs of structs of ``spans(keys, ident, begins, ends, ...)`` with equal keys and a.ident < b.ident of which one
    begins while the other holds, each pair once.

    Keys of at most ``few`` rows meet by a plain join on the key, larger ones by the sweep; both are whole.
    """
    spans = spans.dropna(subset=[*keys, "begins"])
    one = F.struct(*[c for c in spans.columns if c not in keys])
    a, b = F.col("a"), F.col("b")
    ends = lambda x: F.coalesce(x["ends"], F.lit("9999-12-31 23:59:59").cast("timestamp"))
    holds = lambda x, t: (x["begins"] <= t) & (t < ends(x))

    def plain(rows: DataFrame) -> DataFrame:
        met = rows.select(*keys, one.alias("a")).join(rows.select(*keys, one.alias("b")), [*keys]).filter(a[ident] < b[ident])
        return met.filter(holds(a, b["begins"]) | holds(b, a["begins"]))

    counts = spans.groupBy(*keys).agg(F.count("*").alias("c")).filter(F.col("c") > few).select(*keys)
    if not counts.limit(1).count():
        return plain(spans)
    large = stored(counts, "hot-keys")
    hot = stored(spans.join(large, [*keys], "left_semi").withColumn("row", F.monotonically_increasing_id()), "hot-spans")
    found = points_in_intervals(hot.select(*keys, "row", "begins", "ends"), hot.select(*keys, "row", F.col("begins").alias("t")), keys)
    side = lambda name, key, *more: hot.select(*more, F.col("row").alias(key), one.alias(name)).hint("merge")
    both = found.filter("interval <> point").join(side("a", "interval", *keys), "interval").join(side("b", "point"), "point")
    # Two that begin at once each hold the other's beginning: such a pair comes from both sides.
    both = both.filter((a[ident] != b[ident]) & ((a["begins"] < b["begins"]) | (a[ident] < b[ident]) | ~holds(b, a["begins"])))
    turned = F.when(a[ident] < b[ident], F.struct("a", "b")).otherwise(F.struct(b.alias("a"), a.alias("b")))
    return plain(spans.join(large, [*keys], "left_anti")).select(*keys, "a", "b").union(both.select(*keys, turned.alias("p")).select(*keys, "p.a", "p.b"))
