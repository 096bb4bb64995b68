"""Scoring, sampling, stitching and summarising retrieval experiments."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.storage import stored
from factloom.functions.text import strip

PERFECT = 0.99


# ---- scores


def set_prf(pred: Column, gold: Column, extraction: bool = False) -> Column:
    """(precision, recall, f1) of two sets. Both empty is perfect, but for extraction an empty prediction scores 0 and an
    empty gold set leaves precision at 1."""
    tp = F.size(F.array_intersect(pred, gold)).cast("double")
    n, m = F.size(F.array_distinct(pred)), F.size(F.array_distinct(gold))
    p, r = F.try_divide(tp, n), F.try_divide(tp, m)
    f = F.when(tp > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0)
    make = lambda a, b, c: F.struct(F.lit(a).alias("precision"), F.lit(b).alias("recall"), F.lit(c).alias("f1"))
    full = F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))
    if extraction:
        return F.when(n == 0, make(0.0, 0.0, 0.0)).when(m == 0, make(1.0, 0.0, 0.0)).otherwise(full)
    return F.when((n == 0) & (m == 0), make(1.0, 1.0, 1.0)).when((n == 0) | (m == 0), make(0.0, 0.0, 0.0)).otherwise(full)


def exact_match(pred: Column, gold: Column) -> Column:
    """Whether two sets are equal, whatever their order and repeats."""
    return F.array_sort(F.array_distinct(pred)) == F.array_sort(F.array_distinct(gold))


def triple_keys(triples: Column) -> Column:
    """Triples trimmed and lower-cased, as text."""
    return F.transform(triples, lambda t: F.concat_ws("|", F.lower(strip(t["s"])), F.lower(strip(t["p"])), F.lower(strip(t["o"]))))


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def needle_score(response: Column, gold: Column, token: Column, lenient: bool = False) -> Column:
    """0 unless the response starts with the token; else how alike the rest is to the gold answer's rest.

    Equal rests are decided without Python; only rows that pass the prefix and differ reach the matcher.
    """
    said = F.regexp_replace(response, r"^\s+", "") if lenient else response
    cut = lambda t: F.substring(t, F.length(token) + 1, F.lit(2_000_000_000))
    a, b = cut(said), F.when(gold.startswith(token), cut(gold)).otherwise(gold)
    unlike = said.startswith(token) & (a != b)
    ratio = sequence_ratio(F.when(unlike, a), F.when(unlike, b))
    return F.when(~F.coalesce(said.startswith(token), F.lit(False)), 0.0).when(a == b, 1.0).otherwise(ratio)


def answers_found(response: Column, answers: Column) -> Column:
    """(n_found, any_found, all_found): answers contained in the response, whatever their case."""
    n = F.size(F.filter(answers, lambda x: F.contains(F.lower(response), F.lower(x))))
    return F.struct(n.cast("long").alias("n_found"), (n > 0).alias("any_found"), ((n == F.size(answers)) & (n > 0)).alias("all_found"))


def hallucinated(response: Column, gold: Column, token: Column) -> Column:
    head = F.substring(gold, F.length(token) + 1, F.lit(80))
    return (F.length(response) >= 20) & F.contains(response, token) & ~F.contains(response, head)


def truncated(response: Column, gold: Column, lenient: Column) -> Column:
    return (F.length(response) < 0.8 * F.length(gold)) & (lenient > 0.05)


def contradiction_hit(resolution: Column) -> Column:
    return resolution.isin("unresolved", "both_partial")


def op_match(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def longest_common(a: str, b: str) -> str:
    m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    return a[m.a : m.a + m.size]


def verbatim_overlap(sources: DataFrame, answers: DataFrame, least: int, shingle: int = 16) -> DataFrame:
    """(answer_id, source_id, overlap): pairs that share a run of ``least`` characters, with their longest common text.

    A shared run of ``least`` characters contains a whole aligned block of ``shingle`` of the source at any place of the
    answer if ``least >= 2 * shingle - 1``, so an equi-join finds all candidates; only those are compared.
    """
    if least < 2 * shingle - 1:
        raise ValueError("the threshold must be twice the shingle less one at least")
    block = lambda step: F.expr(f"transform(sequence(1, greatest(1, length(text) - {shingle} + 1), {step}), i -> substring(text, i, {shingle}))")
    s = sources.select("source_id", F.explode(F.array_distinct(block(shingle))).alias("gram"))
    a = answers.select("answer_id", F.explode(F.array_distinct(block(1))).alias("gram"))
    pairs = s.hint("merge").join(a, "gram").select("source_id", "answer_id").distinct()
    both = pairs.hint("merge").join(sources.withColumnRenamed("text", "s_text"), "source_id").hint("merge").join(answers.withColumnRenamed("text", "a_text"), "answer_id")

    @F.pandas_udf("string")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([longest_common(p, q) for p, q in zip(x, y, strict=True)])

    out = both.select("answer_id", "source_id", common("s_text", "a_text").alias("overlap"))
    return out.filter(F.length("overlap") >= least)


# ---- buckets and ranks

# Half-open size ranges, in characters.
SIZE_BOUNDS = {"S": (0, 150_000), "M": (150_000, 500_000), "L": (500_000, 1_500_000), "XL": (1_500_000, 5_000_000)}


def size_bucket(size: Column, bounds: dict[str, tuple[int, int]]) -> Column:
    out = F.lit("?")
    for name, (lo, hi) in bounds.items():
        out = F.when((size >= lo) & (size < hi), name).otherwise(out)
    return out


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, roll_up: Callable[[DataFrame], DataFrame] | None = None, fine: Sequence[str] | None = None) -> DataFrame:
    """Percentiles by the four rules in use, and the true median: (keys, n, p50_round, p95_round, p50_floor, upper_median,
    p95_or_max, median). Rounding is half to even.

    Equal values are counted before the shuffle, and the counts are dealt by ranges of values and written. From the sums of
    the ranges follows which of them hold a wanted rank; only their counts are numbered, each range by itself, so no task
    sorts a whole key. Null keys are a group. With ``roll_up`` the counts are kept by the ``fine`` columns, and it makes
    the keys of them: one row may count under several keys.
    """
    fine, roll_up = list(fine or keys), roll_up or (lambda rows: rows)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*fine, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    dealt = stored(counts.repartitionByRange("_v", *fine).withColumn("_part", F.spark_partition_id()), "value-counts")
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_s").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = roll_up(dealt.groupBy(*fine, "_part").agg(F.sum("_c").alias("_s"))).groupBy(*keys, "_part").agg(F.sum("_s").alias("_s"))
    ranges = sums.withColumn("_before", before).withColumn("_n", F.sum("_s").over(key))
    n = F.col("_n")
    rounded = lambda p: F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(p) * (n - 1)))).cast("long")
    floor = lambda p: F.least(n - 1, F.floor(n * p)).cast("long")
    last = F.when(n >= 20, F.floor(n * 0.95).cast("long")).otherwise(n - 1)
    ranks = {"p50_round": rounded(0.5), "p95_round": rounded(0.95), "p50_floor": floor(0.5), "upper_median": F.floor(n / 2).cast("long"), "p95_or_max": last, "_low": F.floor((n - 1) / 2).cast("long")}
    wanted = F.exists(F.array(*ranks.values()), lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_s")))
    ranges = stored(ranges.filter(wanted).select(F.struct(*keys, "_part").alias("_range"), "_before", "_n"), "value-ranges")
    r = roll_up(dealt).join(ranges, F.struct(*keys, "_part").eqNullSafe(F.col("_range")))
    running = Window.partitionBy(*keys, "_part").orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_upto", F.col("_before") + F.sum("_c").over(running))
    # A range without the wanted rank begins after it or ends before it; its values are not looked at for that rank.
    at = lambda i: F.min(F.when((F.col("_upto") > i) & (F.col("_before") <= i), F.col("_v")))
    found = r.groupBy(*keys).agg(F.max("_n").alias("n"), *[at(i).alias(name) for name, i in ranks.items()])
    return found.withColumn("median", F.round((F.col("_low") + F.col("upper_median")) / 2, 6)).drop("_low")


# ---- summaries of runs(row_idx, arm, bucket, status, strict, lenient, latency_ms, ...)

def _ok() -> Column:
    return F.col("status") == "ok"


def _mean(c: Column) -> Column:
    return F.round(F.avg(c), 6)


def _rate(c: Column, among: Column) -> Column:
    return _mean(F.when(among, c.cast("double")))


def summarize_arms(runs: DataFrame) -> DataFrame:
    """Means and perfect rates of scored rows, for each arm and for each bucket of it, in one pass of grouping sets."""
    scored = runs.filter(_ok())
    g = scored.groupingSets([["arm"], ["bucket", "arm"]], "bucket", "arm")
    out = g.agg(F.count("*").alias("n"), _mean("strict").alias("mean_strict"), _mean("lenient").alias("mean_lenient"), _mean((F.col("strict") >= PERFECT).cast("double")).alias("perfect_strict"), _mean((F.col("lenient") >= PERFECT).cast("double")).alias("perfect_lenient"))
    return out


def analyze_arms(runs: DataFrame) -> DataFrame:
    """Per arm: status counts, means, perfect rates, hallucinations, truncations, upper median latency."""
    mid = nearest_rank(runs, ["arm"], "latency_ms").select("arm", F.col("upper_median").alias("median_latency_ms"))
    return runs.groupBy("arm").agg(
        F.count_if(_ok()).alias("n_ok"),
        F.count_if(F.col("status") == "context_overflow").alias("n_overflow"),
        F.count_if(~F.col("status").isin("ok", "context_overflow")).alias("n_err"),
        _rate(F.col("strict"), _ok()).alias("strict_mean"),
        _rate(F.col("lenient"), _ok()).alias("lenient_mean"),
        _rate(F.col("strict") >= PERFECT, _ok()).alias("perfect_strict"),
        _rate(F.col("lenient") >= PERFECT, _ok()).alias("perfect_lenient"),
        F.count_if(_ok() & F.col("hallucinated")).alias("hallucinations"),
        F.count_if(_ok() & F.col("truncated")).alias("truncations"),
    ).join(mid, "arm", "left")


def summarize_graph(runs: DataFrame) -> DataFrame:
    """Per bucket: exact match and F1 of ours and the baseline over runnable and all rows, operator match, status counts, p50."""
    p50 = nearest_rank(runs, ["bucket"], "latency_ms").select("bucket", F.col("p50_floor").alias("p50_ms"))
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "c")))).alias("status_counts")
    per = runs.groupBy("bucket", "status").agg(F.count("*").alias("c")).groupBy("bucket").agg(counts)
    return runs.groupBy("bucket").agg(
        F.count("*").alias("n"),
        _mean((F.col("lenient") >= PERFECT).cast("double")).alias("em"),
        _mean("lenient").alias("f1"),
        _mean(F.col("op_match").cast("double")).alias("op_match_rate"),
        _rate(F.col("strict"), _ok()).alias("baseline_over_runnable"),
        _mean(F.when(_ok(), F.col("strict")).otherwise(0.0)).alias("baseline_over_all"),
    ).join(per, "bucket").join(p50, "bucket", "left")


def summarize_needles(runs: DataFrame) -> DataFrame:
    """Per bucket: mean and perfect rate over all and over runnable rows, p50 latency by the floor rule."""
    p50 = nearest_rank(runs, ["bucket"], "latency_ms").select("bucket", F.col("p50_floor").alias("p50_ms"))
    return runs.groupBy("bucket").agg(
        F.count("*").alias("n"),
        _mean("lenient").alias("mean_ours"),
        _mean((F.col("lenient") >= PERFECT).cast("double")).alias("perfect_ours"),
        _mean(F.when(_ok(), F.col("strict")).otherwise(0.0)).alias("baseline_all"),
        _rate(F.col("strict"), _ok()).alias("baseline_runnable"),
    ).join(p50, "bucket")


def summarize_multikey(runs: DataFrame) -> DataFrame:
    """Found rates of rows with status ok, overall and per bucket."""
    g = runs.filter(_ok()).groupingSets([["arm"], ["arm", "bucket"]], "arm", "bucket")
    return g.agg(F.count("*").alias("n"), _mean(F.col("any_found").cast("double")).alias("any_rate"), _mean(F.col("all_found").cast("double")).alias("all_rate"))


def summarize_contradictions(runs: DataFrame) -> DataFrame:
    """Overall, per type and per bucket: n, hits, errors, accuracy, whether each verdict took one call, latencies.

    Runs are counted once by type and bucket; the three dimensions are sums over those counts.
    """
    good = F.col("status") != "error"
    lat = F.when(good & (F.col("latency_ms") > 0), F.col("latency_ms"))

    def three(rows: DataFrame) -> DataFrame:
        whole = F.lit("all")
        sets = [(whole, whole), (F.lit("type"), F.col("arm")), (F.lit("bucket"), F.col("bucket"))]
        made = rows.withColumn("_k", F.explode(F.array(*[F.struct(a.alias("dimension"), b.alias("value")) for a, b in sets])))
        return made.select("*", "_k.dimension", "_k.value")

    cells = runs.groupBy("arm", "bucket").agg(
        F.count("*").alias("n"),
        F.count_if("hit").alias("hits"),
        F.count("hit").alias("told"),
        F.count_if(~good).alias("errors"),
        F.every(F.when(good, F.col("calls") == 1)).alias("one"),
        F.sum(lat).alias("ms"),
        F.count(lat).alias("timed"),
    )
    out = three(stored(cells, "cells")).groupBy("dimension", "value").agg(
        F.sum("n").alias("n"),
        F.sum("hits").alias("hits"),
        F.sum("errors").alias("errors"),
        F.round(F.try_divide(F.sum("hits"), F.sum("told")), 6).alias("accuracy"),
        F.coalesce(F.every("one"), F.lit(False)).alias("one_call_each"),
        F.round(F.try_divide(F.sum("ms"), F.sum("timed")), 6).alias("mean_ms"),
    )
    ranks = nearest_rank(runs.withColumn("lat", lat), ["dimension", "value"], "lat", three, ["arm", "bucket"])
    ranks = ranks.select("dimension", "value", F.col("median").alias("p50_ms"), F.col("p95_or_max").alias("p95_ms"))
    return out.join(ranks.hint("merge"), ["dimension", "value"], "left")


def latency_profile(samples: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per size and stage: p50 and p95 by rounding, mean. ``samples(size, <stages>)``."""
    long = samples.unpivot("size", list(stages), "stage", "ms")
    r = nearest_rank(long, ["size", "stage"], "ms").select("size", "stage", "n", F.col("p50_round").alias("p50"), F.col("p95_round").alias("p95"))
    return r.hint("merge").join(long.groupBy("size", "stage").agg(_mean("ms").alias("mean")), ["size", "stage"])


def dedupe_turns(records: DataFrame) -> DataFrame:
    """The last record by time for each number of original messages, numbered from 1 in a session."""
    last = records.groupBy("session_id", "original_messages").agg(F.max_by(F.struct("record_id", "original_tokens", "outbound_tokens", "t"), F.struct("t", "record_id")).alias("r"))
    order = Window.partitionBy("session_id").orderBy("original_messages")
    return last.select("session_id", "original_messages", "r.*").withColumn("logical_turn", F.row_number().over(order))


def payload_summary(turns: DataFrame, threshold: int, inclusive: bool = False) -> DataFrame:
    """Per session: largest and upper median outbound tokens, largest original, turns over the threshold, pass flag."""
    over = F.col("outbound_tokens") >= threshold if inclusive else F.col("outbound_tokens") > threshold
    r = nearest_rank(turns, ["session_id"], "outbound_tokens").select("session_id", F.col("upper_median").alias("median_outbound"))
    out = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.max("outbound_tokens").alias("max_outbound"), F.max("original_tokens").alias("max_original"), F.count_if(over).alias("turns_over"), F.bool_or(F.col("outbound_tokens") < F.col("original_tokens")).alias("ever_virtualized"))
    return out.withColumn("passed", F.col("turns_over") == 0).join(r, "session_id")


def group_stats(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Per tenant: episodes, facts, distinct sessions, up to ten sources, the last event."""
    e = episodes.groupBy("group_id").agg(F.count("*").alias("episodes"), F.count_distinct("session_id").alias("sessions"), F.max("event_time").alias("last_event"))
    some = firsts(episodes.select("group_id", "source").dropna(subset=["source"]).distinct(), ["group_id"], ["source"], 10)
    e = e.join(some.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources")), "group_id", "left")
    e = e.withColumn("sources", F.coalesce("sources", F.lit("")))
    f = facts.groupBy("group_id").agg(F.count("*").alias("facts"))
    out = e.join(f, "group_id", "full")
    return out.fillna(0, ["episodes", "sessions", "facts"])


def judge_eval(rows: DataFrame, min_accuracy: float = 0.65, max_p95: float = 15_000.0) -> DataFrame:
    """Accuracy, validity of JSON, p95 latency and the gate."""
    r = nearest_rank(rows.withColumn("_all", F.lit(1)), ["_all"], "latency_ms").select(F.col("p95_or_max").alias("p95_ms"), F.lit(1).alias("_all"))
    out = rows.agg(F.count("*").alias("n"), _mean((F.col("predicted") == F.col("gold")).cast("double")).alias("accuracy"), _mean(F.col("valid").cast("double")).alias("valid_rate")).withColumn("_all", F.lit(1)).join(r, "_all").drop("_all")
    return out.withColumn("passed", (F.col("accuracy") >= min_accuracy) & (F.col("p95_ms") <= max_p95))


def extract_eval(rows: DataFrame, min_f1: float = 0.70, max_p95: float = 8_000.0) -> DataFrame:
    """Mean F1 over examples ``(pred, gold array<struct<s,p,o>>, latency_ms)``, p95 latency and the gate."""
    r = nearest_rank(rows.withColumn("_all", F.lit(1)), ["_all"], "latency_ms").select(F.col("p95_or_max").alias("p95_ms"), "_all")
    keyed = rows.select(triple_keys(F.col("pred")).alias("pred"), triple_keys(F.col("gold")).alias("gold"))  # made once, not at each place of use
    f1 = set_prf(F.col("pred"), F.col("gold"), extraction=True)["f1"]
    out = keyed.agg(F.count("*").alias("n"), _mean(f1).alias("mean_f1")).withColumn("_all", F.lit(1)).join(r, "_all").drop("_all")
    return out.withColumn("passed", (F.col("mean_f1") >= min_f1) & (F.col("p95_ms") <= max_p95))




def call_profile(samples: DataFrame, expected: str) -> DataFrame:
    """Per size of ``samples(size, calls, n_conflicts, resolution, answers array<string>)``: runs, fewest and most calls,
    whether each took one, conflicts (true median and most), the part of runs whose answers hold ``expected``, and the
    distinct answers and resolutions, sorted."""
    mid = nearest_rank(samples, ["size"], "n_conflicts").select("size", F.col("median").alias("conflicts_p50"))
    one = samples.groupBy("size").agg(
        F.count("*").alias("n"),
        F.min("calls").alias("calls_min"),
        F.max("calls").alias("calls_max"),
        F.every(F.col("calls") == 1).alias("all_one"),
        F.max("n_conflicts").alias("conflicts_max"),
        _mean(F.coalesce(F.array_contains("answers", expected), F.lit(False)).cast("double")).alias("correct_rate"),
        F.sort_array(F.collect_set(F.when(F.col("resolution") != "", F.col("resolution")))).alias("resolutions"),
    )
    # Answers are made distinct before they are gathered: the set of a size holds each once.
    seen = samples.select("size", F.explode("answers").alias("a")).distinct().groupBy("size").agg(F.sort_array(F.collect_list("a")).alias("answers"))
    none = F.array().cast("array<string>")
    return one.join(mid.hint("merge"), "size", "left").join(seen.hint("merge"), "size", "left").withColumn("answers", F.coalesce("answers", none))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_idx, arm, status_a, status_b, delta, sign): lenient change of rows that both runs scored."""
    j = a.alias("a").join(b.alias("b"), ["row_idx", "arm"])
    both = (F.col("a.status") == "ok") & (F.col("b.status") == "ok")
    delta = F.when(both, F.round(F.col("b.lenient") - F.col("a.lenient"), 6))
    sign = F.when(delta > 0.001, "+").when(delta < -0.001, "-").when(delta.isNotNull(), "=")
    return j.select("row_idx", "arm", F.col("a.status").alias("status_a"), F.col("b.status").alias("status_b"), delta.alias("delta"), sign.alias("sign"))


def compare_summary(a: DataFrame, b: DataFrame, ours: str, plain: str, frontier: str) -> DataFrame:
    """Arm means of two runs side by side and one verdict on ``ours`` in the second."""
    mean = lambda d, n: d.filter(_ok()).groupBy("arm").agg(_mean("lenient").alias(n))
    both = mean(a, "mean_a").join(mean(b, "mean_b"), "arm", "full").withColumn("delta", F.round(F.col("mean_b") - F.col("mean_a"), 6))
    v = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("mean_b"))).over(Window.partitionBy())
    o, p, f = v(ours), v(plain), v(frontier)
    there = lambda *c: (F.coalesce(c[0], F.lit(0.0)) != 0) & (F.coalesce(c[1], F.lit(0.0)) != 0)
    verdict = F.when(there(o, f) & (o >= 0.90 * f), "on par with the frontier").when(there(o, p) & (o > p + 0.10), "better than plain").when(there(o, p) & (F.abs(o - p) < 0.05), "like plain").otherwise("behind")
    return both.withColumn("verdict", verdict)


# ---- sampling and stitching


def _order(seed: int, ident: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(ident).cast("string")))


def firsts(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, numbered in ``_r``. The limit is a constant, so Spark cuts each key's rows in every
    task before they are shuffled, and no task sorts a whole key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most)


def sample_two_classes(tasks: DataFrame, per_bucket: int, seed: int, extra_to_first: bool = False, ident: str = "task_id", cls: str = "op", first: str = "bfs") -> DataFrame:
    """Per bucket half of one class, the rest from the other; a class that is short is not made up for by the first."""
    quota = per_bucket // 2 + (per_bucket % 2 if extra_to_first else 0)
    r = firsts(tasks, ["bucket", cls], [_order(seed, ident), ident], per_bucket)
    n_first = F.least(F.lit(quota), F.sum((F.col(cls) == first).cast("long")).over(Window.partitionBy("bucket")))
    return r.withColumn("_f", n_first).filter(F.when(F.col(cls) == first, F.col("_r") <= quota).otherwise(F.col("_r") <= per_bucket - F.col("_f"))).drop("_r", "_f")


def sample_needles(rows: DataFrame, per_bucket: int, seed: int, ident: str = "row_idx", over_all: bool = True) -> DataFrame:
    """Per bucket a third for each needle count, then a fill from what is left, in the order of a seeded hash. Ids are unique.

    Over all rows the third is rounded up; else a bucket is cut to ``per_bucket`` rows first and the third rounded down.
    """
    quota = max(1, (per_bucket + 2) // 3) if over_all else max(1, per_bucket // 3)
    key = [_order(seed, ident), F.col(ident)]
    rows = rows if over_all else firsts(rows, ["bucket"], key, per_bucket).drop("_r")
    picked = firsts(rows.filter(F.col("n_needles").isin(2, 4, 8)), ["bucket", "n_needles"], key, quota).withColumn("_r", F.lit(1))
    # Enough to fill a bucket even if all that is picked stands among them.
    others = firsts(rows, ["bucket"], key, per_bucket + 3 * quota).withColumn("_r", F.lit(0))
    both = picked.unionByName(others.join(picked.select(ident), ident, "left_anti"))
    order = [F.desc("_r"), F.when(F.col("_r") == 1, F.col("n_needles")), *key]
    return both.withColumn("_k", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter(F.col("_k") <= per_bucket).drop("_r", "_k")


def quota_plan(total: int) -> dict[str, int]:
    """Rows per bucket: 1, 2, 2 of S, M, L; fewer than five are taken from S, then M, then L; more go to L."""
    plan = {"S": 1, "M": 2, "L": 2}
    short = 5 - total
    for b in ("S", "M", "L"):
        cut = max(0, min(short, plan[b]))
        plan[b] -= cut
        short -= cut
    plan["L"] += max(0, total - 5)
    return plan


def quota_sample(rows: DataFrame, total: int, seed: int, ident: str = "row_idx") -> DataFrame:
    plan = quota_plan(total)
    limit = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(n)) for b, n in plan.items()], F.lit(0))
    return firsts(rows, ["bucket"], [_order(seed, ident), ident], max(plan.values())).filter(F.col("_r") <= limit).drop("_r")


def diverse_pick(rows: DataFrame, n: int, cls: str, ident: str) -> DataFrame:
    """Round robin over classes: the first of each, then the second of each, and so on."""
    return firsts(rows, [cls], [ident], n).orderBy("_r", cls, ident).limit(n).drop("_r")


def distractors_needed(target: int, base: int, largest: int) -> int:
    return max(1, -(-(target - base) // largest))


def stitch_conversations(base: DataFrame, distractors: DataFrame) -> DataFrame:
    """One conversation per stitch_id: the base less its last message, each distractor less its last, the base's last.

    Both are (stitch_id, part, idx, role, text), parts of distractors numbered from 1. Adds ``msg_idx`` and the totals.
    """
    whole = base.withColumn("part", F.lit(0)).unionByName(distractors)
    last = F.max("idx").over(Window.partitionBy("stitch_id", "part"))
    rows = whole.withColumn("_l", F.col("idx") == last).filter("part = 0 or not _l")
    order = Window.partitionBy("stitch_id").orderBy((F.col("_l") & (F.col("part") == 0)).cast("int"), "part", "idx")
    per = Window.partitionBy("stitch_id")
    rows = rows.withColumns({"msg_idx": F.row_number().over(order) - 1, "total_messages": F.count("*").over(per), "n_chars": F.sum(F.length("text")).over(per)})
    return rows.drop("_l")


def stitch_contexts(base: DataFrame, distractors: DataFrame) -> DataFrame:
    """(stitch_id, text): intro, the base's context, all distractors' contexts in order, the question."""
    rest = distractors.groupBy("stitch_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "context"))), lambda x: x["context"]), "\n").alias("more"))
    return base.join(rest, "stitch_id", "left").select("stitch_id", F.concat_ws("\n", "intro", "context", "more", "question").alias("text"))


#: Targets that each row is compared with.
FEW_TARGETS = 1_000


def nearest_to_target(rows: DataFrame, targets: DataFrame, within: float = 0.20) -> DataFrame:
    """(target, row_idx, n_chars): per target the nearest row within 20 %; a null row means one must be made.

    Targets are a list that the caller makes; each row is compared with all of them where it is, and only the best of each
    partition is shuffled. More than FEW_TARGETS are an error: split the list.
    """
    listed = sorted(r["target"] for r in targets.select("target").dropna().distinct().limit(FEW_TARGETS + 1).collect())
    if len(listed) > FEW_TARGETS:
        raise ValueError(f"more than {FEW_TARGETS} targets")
    hit = F.filter(F.array(*map(F.lit, listed)), lambda t: F.abs(F.col("n_chars") - t) <= within * t)
    near = rows.withColumn("target", F.explode(hit))
    best = near.groupBy("target").agg(F.min(F.struct(F.abs(F.col("n_chars") - F.col("target")).alias("far"), "row_idx", "n_chars")).alias("b"))
    return targets.join(best, "target", "left").select("target", F.col("b.row_idx").alias("row_idx"), F.col("b.n_chars").alias("n_chars"))


def resume(dataset: DataFrame, done: DataFrame, ident: str) -> DataFrame:
    """What of a dataset is still to be run."""
    return dataset.join(done.select(ident), ident, "left_anti")
