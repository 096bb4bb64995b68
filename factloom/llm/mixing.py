"""Temperature mixing of sources (DataFrame functions only).

A source's share of all tokens, raised to an exponent and normalised, is its weight. The exponent is bisected: 1 keeps
the natural shares, 0 makes them equal. Weights become token budgets, and budgets become whole passes over a source plus
the first blocks of one more pass in permuted order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored, word_count

STEPS = 50
#: First hexadecimal digits of MD5 that place a document in one of 4,096 blocks of its source.
BLOCK_DIGITS = 3


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def solve_exponent(shares: Column, max_repeats: float | None, target_entropy: float | None) -> Column:
    """Bisect the exponent over [0, 1] inside one expression.

    ``max_repeats``: the smallest exponent at which no source's weight exceeds ``max_repeats`` times the rate at which
    the source repeated least is drawn. ``target_entropy``: the largest exponent whose weights have that entropy (as a
    part of the largest possible one, the logarithm of the number of sources).
    """

    def too_flat(e: Column) -> Column:
        if max_repeats is not None:
            rate = F.transform(shares, lambda s: F.pow(s, e - 1.0))
            return F.array_max(rate) > F.array_min(rate) * max_repeats
        powers = F.transform(shares, lambda s: F.pow(s, e))
        total = _sum(powers)
        entropy = _sum(F.transform(powers, lambda p: -(p / total) * F.log(p / total)))
        return entropy >= F.log(F.size(shares).cast("double")) * target_entropy

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        flat = too_flat(mid)
        return F.struct(F.when(flat, mid).otherwise(acc["lo"]).alias("lo"), F.when(flat, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    ends = found["hi"] if max_repeats is not None else found["lo"]
    if max_repeats is not None:  # equal weights may already be within the limit
        return F.when(too_flat(F.lit(0.0)), ends).otherwise(F.lit(0.0))
    return F.when(too_flat(F.lit(1.0)), F.lit(1.0)).otherwise(ends)


def source_weights(tokens: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, source_tokens, share, exponent, weight, budget_tokens) from (source, source_tokens).

    The table has a row per source, which is a configuration-sized list; it is gathered into one row for the bisection.
    ``budget`` is the number of tokens wanted; by default the smallest number that reads every source once. Sources
    without tokens get weight 0 and the budget 0.
    """
    t = tokens.filter("source_tokens > 0")
    one = t.agg(F.sort_array(F.collect_list(F.struct("source_tokens", "source"))).alias("all"), F.sum("source_tokens").cast("double").alias("total"))
    shares = F.transform("all", lambda s: s["source_tokens"] / F.col("total"))
    one = one.select("all", "total", shares.alias("shares"))
    one = one.select("all", "total", solve_exponent(F.col("shares"), max_repeats, target_entropy).alias("exponent"), "shares")
    one = one.withColumn("norm", _sum(F.transform("shares", lambda s: F.pow(s, F.col("exponent")))))
    rows = one.select("total", "exponent", "norm", F.explode("all").alias("s"), F.array_min(F.transform("shares", lambda s: F.pow(s, F.col("exponent") - 1.0) / F.col("norm"))).alias("least"))
    share = F.col("s.source_tokens") / F.col("total")
    weight = F.pow(share, F.col("exponent")) / F.col("norm")
    whole = F.col("total") / F.col("least") if budget is None else F.lit(float(budget))
    # A relative 1e-9 keeps a source that is read a whole number of times from losing a token to rounding.
    return rows.select(F.col("s.source").alias("source"), F.col("s.source_tokens").alias("source_tokens"), share.alias("share"), "exponent", weight.alias("weight"), F.floor(weight * whole * (1 + 1e-9)).cast("long").alias("budget_tokens"))


def _plan(docs: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their tokens and blocks, blocks with what of the last pass is left for them, passes and rest per source)."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", word_count("text").alias("n_tokens"), F.substring(F.md5(key), 1, BLOCK_DIGITS).alias("block"))
    rows = stored(rows, "mix-rows")
    blocks = stored(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "mix-blocks")
    tokens = blocks.groupBy("source").agg(F.sum("block_tokens").alias("source_tokens"))
    weights = stored(source_weights(tokens, max_repeats, target_entropy, budget), "mix-weights")
    per_source = tokens.select("source", "source_tokens").alias("t").join(weights.alias("w"), F.expr("t.source <=> w.source"), "left")
    per_source = per_source.select(
        F.col("t.source").alias("source"),
        F.col("w.exponent").alias("exponent"),
        F.coalesce("w.budget_tokens", F.lit(0)).alias("budget_tokens"),
        F.when(F.col("t.source_tokens") > 0, F.expr("coalesce(w.budget_tokens, 0) div t.source_tokens")).otherwise(F.lit(1)).alias("passes"),
        F.when(F.col("t.source_tokens") > 0, F.expr("coalesce(w.budget_tokens, 0) % t.source_tokens")).otherwise(F.lit(0)).alias("rest"),
    )
    per_source = stored(per_source, "mix-sources")
    # Blocks in the last pass: those that fit whole, and the one in which the budget ends.
    b = blocks.alias("b").hint("merge").join(per_source.alias("s"), F.expr("b.source <=> s.source"))
    b = b.select("b.source", "b.block", "b.block_tokens", "s.exponent", "s.budget_tokens", "s.passes", "s.rest")
    order = Window.partitionBy("source").orderBy(_last_block(), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("upto", F.sum("block_tokens").over(order))
    b = stored(b.withColumn("left_here", F.greatest(F.lit(0), F.col("rest") - (F.col("upto") - F.col("block_tokens")))).drop("upto", "rest"), "mix-plan")
    return rows, b, per_source


def _last_block() -> Column:
    """Where a block stands in the last pass."""
    return _md5(F.col("block"), F.col("passes").cast("string"))


def _last_place(epoch: str) -> list[Column]:
    """Where a document stands in its block in the last pass."""
    return [_md5(F.col("doc_id").cast("string"), F.col(epoch).cast("string")), F.col("doc_id")]


def mix_sources(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, exponent, budget_tokens): a row for each time that a row is drawn.

    Epochs 0, 1, ... read the whole source. The last epoch reads a prefix of the blocks in permuted order, and of the
    block in which the budget ends the documents, also in permuted order, that still fit. Rows of one block and epoch
    stand together in the order of (md5 of block and epoch, md5 of document and epoch). A null source is a source of its
    own. Documents without words are drawn once in each whole epoch; sources that only have such documents are read once.
    Repeated rows count as rows. Empty tables give empty results; extra columns are ignored.
    """
    rows, b, _ = _plan(docs, max_repeats, target_entropy, budget)
    r = rows.alias("r").hint("merge").join(b.alias("b"), F.expr("r.block = b.block and r.source <=> b.source"))
    r = r.select("r.doc_id", "r.source", "r.n_tokens", "r.block", "b.exponent", "b.budget_tokens", "b.passes", "b.left_here", "b.block_tokens")
    whole = r.filter("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    last = r.filter("left_here > 0 and n_tokens > 0").withColumn("epoch", F.col("passes").cast("long"))
    full = last.filter("left_here >= block_tokens")
    inside = Window.partitionBy("source", "block").orderBy(*_last_place("epoch")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = last.filter("left_here < block_tokens").withColumn("upto", F.sum("n_tokens").over(inside)).filter("upto <= left_here").drop("upto")
    out = whole.unionByName(full).unionByName(ends)
    return out.select("doc_id", "source", "n_tokens", "epoch", "block", "exponent", "budget_tokens")


def repeat_rows(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """Whole rows of ``docs``, each as often as :func:`mix_sources` draws it; texts are not shuffled.

    The last pass over a source ends at one place in the permuted order, so a row tells from its source's place alone
    whether it is drawn again. Rows that share an id and the last place are drawn alike. Columns stay as they are.
    """
    rows, b, per_source = _plan(docs, max_repeats, target_entropy, budget)
    whole = b.filter("left_here > 0 and left_here >= block_tokens").groupBy("source").agg(F.max(_last_block()).alias("upto_block"))
    ends = b.filter("left_here > 0 and left_here < block_tokens").select("source", F.col("block").alias("end_block"), "passes", "left_here")
    r = rows.filter("n_tokens > 0").alias("r").hint("merge").join(ends.alias("e"), F.expr("r.block = e.end_block and r.source <=> e.source")).select("r.source", "r.doc_id", "r.n_tokens", "e.end_block", "e.passes", "e.left_here")
    inside = Window.partitionBy("source", "end_block").orderBy(*_last_place("passes")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("upto", F.sum("n_tokens").over(inside)).filter("upto <= left_here")
    place = F.struct(*[c.alias(n) for c, n in zip(_last_place("passes"), ("m", "i"), strict=True)])
    ends = r.groupBy("source", "end_block").agg(F.max(place).alias("upto_row"))
    p = per_source.alias("p").join(stored(whole, "mix-whole").alias("w"), F.expr("p.source <=> w.source"), "left").join(stored(ends, "mix-ends").alias("x"), F.expr("p.source <=> x.source"), "left")
    # One row per source, written first: Spark broadcasts it if it is small and merges if it is not.
    plan = stored(p.select(F.struct("p.source", "p.passes", "w.upto_block", "x.end_block", "x.upto_row").alias("plan")), "mix-places")
    # A row travels as one struct, so no name of its columns can clash with the plan's.
    own, at = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lambda c: F.col(f"row.{c}")
    block, passes = F.substring(F.md5(F.coalesce(at("doc_id").cast("string"), F.lit(""))), 1, BLOCK_DIGITS), F.col("plan.passes").cast("string")
    here = F.struct(_md5(at("doc_id").cast("string"), passes).alias("m"), at("doc_id").alias("i"))
    again = (_md5(block, passes) <= F.col("plan.upto_block")) | ((block == F.col("plan.end_block")) & (here <= F.col("plan.upto_row")))
    again = F.coalesce(again, F.lit(False)) & F.coalesce(at("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    times = F.col("plan.passes") + F.when(again, 1).otherwise(0)
    out = docs.select(own).join(plan, at("source").eqNullSafe(F.col("plan.source"))).filter(times > 0)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("row.*")


#: The query's parameters.
MAX_REPEATS = 2.0

ORACLE = rf"""
with recursive r as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens,
    substr(md5(coalesce(doc_id::varchar, '')), 1, {BLOCK_DIGITS}) as block from documents),
b as (select source, block, sum(n_tokens)::bigint as block_tokens from r group by all),
t as (select source, sum(block_tokens)::bigint as source_tokens from b group by all),
sh as (select list(source_tokens / total order by source_tokens, source) as shares from (select *, sum(source_tokens) over ()::double as total from t where source_tokens > 0)),
s(i, lo, hi) as (select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when flat then mid else lo end, case when flat then hi else mid end
  from (select i, lo, hi, (lo + hi) / 2 as mid,
          list_max(list_transform(shares, lambda x: pow(x, (lo + hi) / 2 - 1))) > list_min(list_transform(shares, lambda x: pow(x, (lo + hi) / 2 - 1))) * {MAX_REPEATS} as flat from s, sh) where i < {STEPS}),
e as (select case when list_max(list_transform(shares, lambda x: pow(x, -1.0))) > list_min(list_transform(shares, lambda x: pow(x, -1.0))) * {MAX_REPEATS} then hi else 0.0 end as exponent, shares
  from s, sh where i = {STEPS}),
w as (select t.source, source_tokens, exponent, pow(source_tokens / total, exponent) / norm as weight, total / list_min(list_transform(shares, lambda x: pow(x, exponent - 1) / norm)) as whole
  from t, (select *, list_sum(list_transform(shares, lambda x: pow(x, exponent))) as norm from e), (select sum(source_tokens)::double as total from t) where source_tokens > 0),
p as (select t.source, exponent, coalesce(bt, 0) as budget_tokens, case when t.source_tokens > 0 then coalesce(bt, 0) // t.source_tokens else 1 end as passes,
    case when t.source_tokens > 0 then coalesce(bt, 0) % t.source_tokens else 0 end as rest
  from t left join (select source, exponent, floor(weight * whole * (1 + 1e-9))::bigint as bt from w) w on t.source is not distinct from w.source),
q as (select b.source, b.block, block_tokens, exponent, budget_tokens, passes,
    greatest(0, rest - (sum(block_tokens) over (partition by b.source order by md5(b.block || '/' || passes::varchar), b.block) - block_tokens)) as left_here
  from b join p on b.source is not distinct from p.source),
j as (select r.*, exponent, budget_tokens, passes, left_here, block_tokens from r join q on r.block = q.block and r.source is not distinct from q.source),
l as (select *, sum(n_tokens) over (partition by source, block order by md5(coalesce(doc_id::varchar || '/', '') || passes::varchar), doc_id rows unbounded preceding) as upto from j where left_here > 0 and n_tokens > 0)
select doc_id, source, n_tokens, epoch::bigint as epoch, block, round(exponent, 9) as exponent, budget_tokens from (
  select doc_id, source, n_tokens, unnest(range(passes)) as epoch, block, exponent, budget_tokens from j where passes > 0
  union all
  select doc_id, source, n_tokens, passes, block, exponent, budget_tokens from l where left_here >= block_tokens or upto <= left_here)
"""
