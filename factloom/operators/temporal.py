"""Bi-temporal facts: reads as of a point in time, contradictions, supersession, and folding of changes.

Facts hold in the half-open interval [valid_at, invalid_at); a null end is open. ``group_id`` separates tenants and leads
every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.storage import stored
from factloom.operators.intervals import FEW, points_in_intervals, self_overlaps

OPEN_END = "9999-12-31 23:59:59"
KEY = ["group_id", "subject", "predicate"]


def holds_at(anchor: Column | str, include_invalidated: bool = False) -> Column:
    t = F.lit(anchor).cast("timestamp") if isinstance(anchor, str) else anchor
    begun = F.col("valid_at") <= t
    return begun if include_invalidated else begun & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def as_of(facts: DataFrame, anchor: str, include_invalidated: bool = False) -> DataFrame:
    return facts.filter(holds_at(anchor, include_invalidated))


#: Anchors up to which each row of facts is compared with its tenant's list of them where it is.
FEW_ANCHORS = 10_000


def as_of_many(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Snapshots at many times, ``anchors(group_id, anchor)``: each fact once for each of its tenant's anchors at which it holds.

    A counted list of few anchors is broadcast, one row a tenant, and facts do not move; beyond that a sweep brings each
    fact together with the anchors inside its interval alone. Repeated anchors count once.
    """
    wanted = anchors.select("group_id", "anchor").dropna().distinct()
    if wanted.limit(FEW_ANCHORS + 1).count() <= FEW_ANCHORS:
        lists = wanted.groupBy("group_id").agg(F.collect_list("anchor").alias("_anchors"))
        met = facts.join(F.broadcast(lists), "group_id")
        return met.withColumn("anchor", F.explode(F.filter("_anchors", lambda t: holds_at(t)))).drop("_anchors")
    rows = stored(facts.select(F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("fact"), F.monotonically_increasing_id().alias("interval")), "facts")
    points = stored(wanted.withColumn("point", F.monotonically_increasing_id()), "anchors")
    spans = rows.select(F.col("fact.group_id").alias("group_id"), F.col("interval").alias("row"), F.col("fact.valid_at").alias("begins"), F.col("fact.invalid_at").alias("ends"))
    found = points_in_intervals(spans, points.select("group_id", F.col("point").alias("row"), F.col("anchor").alias("t")), ["group_id"])
    return found.join(rows.hint("merge"), "interval").join(points.select("point", "anchor").hint("merge"), "point").select("fact.*", "anchor")


def tier_filter(facts: DataFrame, tiers: Sequence[str] = ("T1", "T2")) -> DataFrame:
    return facts.filter(F.col("tier").isin(*tiers))


def scope_filter(facts: DataFrame, group: str) -> DataFrame:
    return facts if group == "*" else facts.filter(F.col("group_id") == group)


def facts_by_term(facts: DataFrame, terms: DataFrame, cap: int = 256) -> DataFrame:
    """Facts whose subject, object or predicate equals a term of ``terms(term)``, newest first, at most ``cap`` a term.

    Three equi-joins rather than one join on a disjunction, which Spark could only run as nested loops.
    """
    found = None
    for role in ("subject", "object", "predicate"):
        part = facts.withColumn("term", F.col(role)).join(terms.select("term").distinct(), "term", "left_semi")
        found = part if found is None else found.unionByName(part)
    newest = Window.partitionBy("term").orderBy(F.desc("valid_at"), "fact_id")
    return found.dropDuplicates(["term", "fact_id"]).withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= cap)


def conflicts_on_insert(new: DataFrame, facts: DataFrame) -> DataFrame:
    """For each new fact the earlier-arrived ones that it contradicts: (fact_id, conflicts array<long>).

    Same tenant, subject and predicate, another object, and not ended when the new fact begins. Nothing is invalidated.
    """
    o = facts.select(*KEY, F.col("fact_id").alias("other"), F.col("object").alias("o_object"), F.col("invalid_at").alias("o_end"))
    hit = new.join(o, KEY).filter("other < fact_id and o_object <> object and (o_end is null or o_end > valid_at)")
    return hit.groupBy("fact_id").agg(F.sort_array(F.collect_set("other")).alias("conflicts"))


def conflict_pairs(facts: DataFrame, anchor: str | None = None, few: int = FEW) -> DataFrame:
    """Pairs of facts that contradict each other while both hold, each pair once: (group_id, subject, predicate, e1, e2).

    Facts of a key with at most ``few`` of them meet by an equi-join; larger keys are swept, so facts that never hold
    together never meet. A fact that ends before it begins holds at no time but counts while others hold around it, as in
    the plain comparison of both ends.
    """
    live = facts if anchor is None else as_of(facts, anchor)
    rows = live.select(*KEY, "fact_id", "object", F.col("valid_at").alias("begins"), F.col("invalid_at").alias("ends"))
    met = self_overlaps(rows, KEY, "fact_id", few)
    open_end = F.lit(OPEN_END).cast("timestamp")
    both = (F.col("a.begins") < F.coalesce("b.ends", open_end)) & (F.col("b.begins") < F.coalesce("a.ends", open_end))
    met = met.filter((F.col("a.object") != F.col("b.object")) & both)
    return met.select(*KEY, F.col("a.fact_id").alias("e1"), F.col("b.fact_id").alias("e2"), F.col("a.object").alias("o1"), F.col("b.object").alias("o2"))


def conflict_keys(facts: DataFrame) -> DataFrame:
    """Keys by their number of facts and of objects: where pairs would be many."""
    return facts.groupBy(*KEY).agg(F.count("*").alias("n_facts"), F.count_distinct("object").alias("n_objects"))


def siblings(seeds: DataFrame, facts: DataFrame, anchor: str) -> DataFrame:
    """Every seed with the facts that contradict it at the anchor, possibly none: (query_id, fact_id, siblings)."""
    end = F.coalesce("invalid_at", F.lit(OPEN_END).cast("timestamp"))
    o = as_of(facts, anchor).select(*KEY, F.col("fact_id").alias("other"), F.col("object").alias("o_object"), F.col("valid_at").alias("o_start"), end.alias("o_end"))
    s = seeds.withColumn("s_end", end).alias("s").join(
        o.alias("o"),
        F.expr(" and ".join(f"s.{k} = o.{k}" for k in KEY) + " and o.other <> s.fact_id and o.o_object <> s.object and s.valid_at < o.o_end and o.o_start < s.s_end"),
        "left",
    )
    return s.groupBy("s.query_id", "s.fact_id").agg(F.sort_array(F.collect_set("o.other")).alias("siblings"))


def entities(facts: DataFrame) -> DataFrame:
    """(group_id, name, last_updated): names of subjects and objects, stamped when first seen."""
    both = facts.select("group_id", F.explode(F.array("subject", "object")).alias("name"), "valid_at")
    return both.groupBy("group_id", "name").agg(F.min("valid_at").alias("last_updated"))


def _in_window(facts: DataFrame, end: str, start: str | None) -> DataFrame:
    lo = F.lit(start or "1900-01-01 00:00:00").cast("timestamp")
    out = facts.filter((F.col("valid_at") <= F.lit(end).cast("timestamp")) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > lo)))
    return out.filter(F.col("valid_at") >= lo) if start else out


def supersessions(facts: DataFrame, end: str, start: str | None = None, distinct_objects: bool = False) -> DataFrame:
    """(group_id, subject, predicate, winner, loser): the newest fact of a subject and predicate supersedes the others.

    The newest one is an aggregate and the others meet it in a join that Spark can split, so no task holds a whole key.
    """
    rows = _in_window(facts, end, start).dropna(subset=KEY)
    # Ids are turned round, so that of facts that begin together the smallest wins.
    newest = rows.groupBy(*KEY).agg(F.max(F.struct("valid_at", (-F.col("fact_id")).alias("turned"), "object")).alias("w"))
    newest = newest.select(*KEY, (-F.col("w.turned")).alias("winner"), F.col("w.object").alias("w_object"))
    losers = rows.select(*KEY, "fact_id", "object").join(newest, KEY).filter("fact_id <> winner")
    if distinct_objects:
        losers = losers.filter("object <> w_object")
    return losers.select(*KEY, "winner", F.col("fact_id").alias("loser"))


def merges(facts: DataFrame, end: str, start: str | None = None, distinct_objects: bool = False) -> DataFrame:
    """One proposed merge per subject and predicate, with all losers."""
    s = supersessions(facts, end, start, distinct_objects)
    return s.groupBy(*KEY, "winner").agg(F.sort_array(F.collect_list("loser")).alias("losers"))


#: Changes of a fact beyond which they are folded in parts.
FEW_CHANGES = 1_000


def _change(up: Column) -> Column:
    """A confirmation or correction as a map from x to min(hi, max(lo, x + add))."""
    inf = F.lit(float("inf"))
    return F.struct(F.when(up, 0.2).otherwise(-0.4).alias("add"), F.when(up, -inf).otherwise(0.0).alias("lo"), F.when(up, 1.0).otherwise(inf).alias("hi"))


def _then(f: Column, g: Column) -> Column:
    """First ``f``, then ``g``: again a map of that kind, which makes the fold associative."""
    bound = lambda x: F.least(g["hi"], F.greatest(g["lo"], x + g["add"]))
    return F.struct((f["add"] + g["add"]).alias("add"), bound(f["lo"]).alias("lo"), bound(f["hi"]).alias("hi"))


def apply_attestations(facts: DataFrame, mutations: DataFrame, few: int = FEW_CHANGES) -> DataFrame:
    """Fold confirmations and corrections in time order.

    confirmed: confidence up by 0.2 to 1 at most, pinned. corrected: down by 0.4 to 0 at least, not pinned. Other actions
    change nothing. Clamping makes the order matter, but clamped additions compose into clamped additions: the changes of a
    fact with more than ``few`` are dealt by ranges of time, each range is composed where it is, and the fact's row meets
    one map a range.
    """
    none = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    acts = mutations.filter(F.col("action").isin("confirmed", "corrected")).select("fact_id", "ts", "mutation_id", "action", "actor")
    hot = stored(acts.groupBy("fact_id").agg(F.count("*").alias("c")).filter(F.col("c") > few).select("fact_id"), "hot-facts")
    parts = acts.withColumn("part", F.lit(0))
    if hot.limit(1).count():
        dealt = acts.join(hot, "fact_id", "left_semi").repartitionByRange("fact_id", "ts", "mutation_id")
        parts = acts.join(hot, "fact_id", "left_anti").withColumn("part", F.lit(0)).unionByName(stored(dealt.withColumn("part", F.spark_partition_id()), "hot-changes"))
    last = F.struct("ts", "mutation_id", "action", "actor")
    per = parts.groupBy("fact_id", "part").agg(F.sort_array(F.collect_list(F.struct("ts", "mutation_id", "action"))).alias("acts"), F.max(last).alias("last"))
    per = per.select("fact_id", "part", "last", F.aggregate("acts", none, lambda f, m: _then(f, _change(m["action"] == "confirmed"))).alias("map"))
    per = per.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("part", "map"))).alias("maps"), F.max("last").alias("last"))
    per = per.select("fact_id", F.col("last").alias("_last"), F.aggregate("maps", none, lambda f, m: _then(f, m["map"])).alias("_map"))
    out, start = facts.join(per, "fact_id", "left"), F.col("confidence").cast("double")
    changed = F.least(F.col("_map.hi"), F.greatest(F.col("_map.lo"), start + F.col("_map.add")))
    untouched = F.col("_map").isNull()
    return out.withColumns({
        "confidence": F.when(untouched | start.isNull(), start).otherwise(changed),
        "pinned": F.when(untouched, F.col("pinned")).otherwise(F.col("_last.action") == "confirmed"),
        "last_attested_at": F.col("_last.ts"),
        "last_attested_by": F.col("_last.actor"),
    }).drop("_last", "_map")


def apply_invalidations(facts: DataFrame, mutations: DataFrame) -> DataFrame:
    """The first end wins, whether stored or invalidated; reason and actor are those of the last invalidation."""
    acts = mutations.filter("action = 'invalidate'")
    order = F.struct("ts", "mutation_id")
    per = acts.groupBy("fact_id").agg(F.min("ts").alias("i_ts"), F.max_by("reason", order).alias("invalidate_reason"), F.max_by("actor", order).alias("invalidated_by"))
    out = facts.join(per, "fact_id", "left")
    return out.withColumn("invalid_at", F.coalesce("invalid_at", "i_ts")).drop("i_ts")


def unknown_ids(facts: DataFrame, mutations: DataFrame) -> DataFrame:
    """Mutations of facts that do not exist."""
    return mutations.join(facts.select("fact_id"), "fact_id", "left_anti")


def delete_facts(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.select("fact_id"), "fact_id", "left_anti")


def delete_episodes(episodes: DataFrame, facts: DataFrame, ids: DataFrame, cascade: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes left, facts left, (episode_id, removed fact ids)). Vectors are columns and go with their rows."""
    gone = ids.select("episode_id").distinct()
    left = episodes.join(gone, "episode_id", "left_anti")
    hit = facts.withColumnRenamed("source_episode_id", "episode_id").join(gone, "episode_id", "left_semi")
    removed = gone.join(hit.groupBy("episode_id").agg(F.sort_array(F.collect_list("fact_id")).alias("removed")), "episode_id", "left")
    if not cascade:
        return left, facts, removed.withColumn("removed", F.array().cast("array<long>"))
    kept = facts.join(gone.withColumnRenamed("episode_id", "source_episode_id"), "source_episode_id", "left_anti")
    return left, kept, removed.withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))


def wipe_group(table: DataFrame, group: str) -> DataFrame:
    return table.filter(F.col("group_id") != group)


def bulk_load_facts(rows: DataFrame, path: str) -> None:
    """Append facts with the defaults for what they lack, one folder per tenant."""
    for name, default in {"confidence": F.lit(0.9), "tier": F.lit("T2"), "invalid_at": F.lit(None).cast("timestamp"), "pinned": F.lit(False)}.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in rows.columns else default)
    rows.write.mode("append").partitionBy("group_id").parquet(path)


def make_scale_facts(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Five facts about one subject that contradict each other, and n - 5 others over 60 subjects, 10 predicates, 80 objects."""
    pick = lambda salt, m: F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}/{salt}")), F.lit(m))
    hot = F.col("id") < 5
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return spark.range(n).select(
        F.col("id").alias("fact_id"),
        F.lit("scale").alias("group_id"),
        F.when(hot, "alice").otherwise(F.concat(F.lit("subject_"), pick("s", 60))).alias("subject"),
        F.when(hot, "lives_in").otherwise(F.concat(F.lit("predicate_"), pick("p", 10))).alias("predicate"),
        F.when(hot, F.concat(F.lit("city_"), F.col("id"))).otherwise(F.concat(F.lit("object_"), pick("o", 80))).alias("object"),
        F.timestamp_add("DAY", F.when(hot, F.col("id")).otherwise(pick("d", 730)).cast("int"), start).alias("valid_at"),
        F.lit(None).cast("timestamp").alias("invalid_at"),
        F.lit("T2").alias("tier"),
        F.lit(0.9).alias("confidence"),
    )
