"""Registered queries over facts, vectors and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.storage import new_folder
from factloom.functions.tokens import tokens_or_one
from factloom.operators import coarse, graph, inference, temporal, vectors
from factloom.plans import fixtures as fx
from factloom.sources import commits

A = fx.ANCHOR
KEY = ["group_id", "subject", "predicate"]
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(c: str):
    return F.date_format(c, STAMP).alias(c)


def facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    f = temporal.scope_filter(temporal.tier_filter(temporal.as_of(fx.facts(spark, d), A)), fx.SCOPE)
    return f.select("fact_id", *KEY, "object", stamp("valid_at"), stamp("invalid_at"), "tier", "pinned")


def facts_as_of_many(spark: SparkSession, d: str) -> DataFrame:
    f = fx.facts(spark, d)
    days = spark.range(1, 29, 9).select(F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("anchor"))
    anchors = f.select("group_id").distinct().join(F.broadcast(days.withColumn("group_id", F.explode(F.array(*[F.lit(f"g{i}") for i in range(4)])))), "group_id")
    return temporal.as_of_many(f, anchors).groupBy("group_id", stamp("anchor")).agg(F.count("*").alias("n_facts"), F.count_distinct("subject").alias("n_subjects"))


def facts_by_term(spark: SparkSession, d: str) -> DataFrame:
    f = temporal.tier_filter(temporal.as_of(fx.facts(spark, d), A))
    terms = f.select(F.col("subject").alias("term")).union(f.select("object")).union(f.select("predicate")).distinct()
    return temporal.facts_by_term(f, terms).select("term", "rank", "fact_id", stamp("valid_at"))


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return temporal.conflict_pairs(fx.facts(spark, d))


def conflicts_on_insert(spark: SparkSession, d: str) -> DataFrame:
    f = fx.facts(spark, d)
    return temporal.conflicts_on_insert(f, f).select("fact_id", F.size("conflicts").cast("long").alias("n_conflicts"), F.array_join(F.col("conflicts").cast("array<string>"), ",").alias("conflicts"))


def conflict_keys(spark: SparkSession, d: str) -> DataFrame:
    return temporal.conflict_keys(fx.facts(spark, d))


def siblings_left(spark: SparkSession, d: str) -> DataFrame:
    f = temporal.as_of(fx.facts(spark, d), A)
    s = temporal.siblings(f.withColumn("query_id", F.col("fact_id") % 5), f, A)
    return s.select("query_id", "fact_id", F.array_join(F.col("siblings").cast("array<string>"), ",").alias("siblings"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return temporal.entities(fx.facts(spark, d)).select("group_id", "name", stamp("last_updated"))


def supersessions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.supersessions(fx.facts(spark, d), A)


def supersessions_distinct(spark: SparkSession, d: str) -> DataFrame:
    return temporal.supersessions(fx.facts(spark, d), A, start="2024-01-05 00:00:00", distinct_objects=True)


def merges(spark: SparkSession, d: str) -> DataFrame:
    m = temporal.merges(fx.facts(spark, d), A)
    return m.select(*KEY, "winner", F.array_join(F.col("losers").cast("array<string>"), ",").alias("losers"))


def attest_fold(spark: SparkSession, d: str) -> DataFrame:
    f = temporal.apply_attestations(fx.facts(spark, d), fx.mutations(spark, d))
    return f.select("fact_id", F.round("confidence", 6).alias("confidence"), "pinned", stamp("last_attested_at"), "last_attested_by")


def invalidate_fold(spark: SparkSession, d: str) -> DataFrame:
    f = temporal.apply_invalidations(fx.facts(spark, d), fx.mutations(spark, d))
    return f.select("fact_id", stamp("invalid_at"), "invalidate_reason", "invalidated_by")


def delete_facts(spark: SparkSession, d: str) -> DataFrame:
    gone = fx.mutations(spark, d).filter("action = 'delete'")
    return temporal.delete_facts(fx.facts(spark, d), gone).groupBy("group_id").agg(F.count("*").alias("n_facts"), F.sum("fact_id").alias("ids"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    e = fx.episodes(spark, d)
    _, _, removed = temporal.delete_episodes(e, fx.facts(spark, d), e.filter("episode_id % 700 = 0"))
    return removed.select("episode_id", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def cascade_facts_left(spark: SparkSession, d: str) -> DataFrame:
    e = fx.episodes(spark, d)
    _, left, _ = temporal.delete_episodes(e, fx.facts(spark, d), e.filter("episode_id % 700 = 0"))
    return left.groupBy("source_episode_id").agg(F.count("*").alias("n_facts"))


def unknown_mutations(spark: SparkSession, d: str) -> DataFrame:
    kept = temporal.wipe_group(fx.facts(spark, d), fx.SCOPE)
    return temporal.unknown_ids(kept, fx.mutations(spark, d)).select("mutation_id", "fact_id", "action")


def _items(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    """Facts with their vectors."""
    f = fx.facts(spark, d) if f is None else f
    return f.select("fact_id", "group_id", "tier", "vec_id").join(fx.vectors(spark, d), "vec_id")


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(fx.queries(spark, d), fx.facts(spark, d), 16, shared=fx.vectors(spark, d))


def knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn_approx(fx.queries(spark, d), fx.facts(spark, d), 16, shared=fx.vectors(spark, d))


def knn_lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """The approximate search against the exact one, per scope: nine tenths of the neighbours at least."""
    r = vectors.recall_at(knn_lsh(spark, d), knn_exact(spark, d), fx.queries(spark, d))
    return r.select("scope", "n_queries", "n_exact", (F.col("recall") >= 0.9).alias("recall_holds"))


def _coarse(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """(found, what each scope holds, depth): the trained index over all facts' vectors, searched as far as its measured reach asks."""
    index = coarse.fit_index(fx.facts(spark, d), 64, shared=fx.vectors(spark, d))
    q = fx.queries(spark, d)
    probes, depth = coarse.reach(index, q, 16)
    return coarse.search_index(index, q, 16, probes, depth), index.held, depth


def knn_coarse(spark: SparkSession, d: str) -> DataFrame:
    return _coarse(spark, d)[0]


def knn_coarse_recall(spark: SparkSession, d: str) -> DataFrame:
    """Per scope how many exact neighbours the trained index finds, and which part of the scope's vectors it reads."""
    found, held, depth = _coarse(spark, d)
    r = vectors.recall_at(found, knn_exact(spark, d), fx.queries(spark, d))
    items = held.groupBy("scope").agg(F.count("*").alias("n_items"))
    r = r.join(items, "scope").withColumn("read", F.least(F.lit(1.0), F.lit(depth) / F.col("n_items")))
    return r.select("scope", "n_queries", "n_exact", F.round("recall", 3).alias("recall"), F.round("read", 4).alias("read"), (F.col("recall") >= 0.9).alias("recall_holds"), (F.col("read") <= 0.1).alias("reads_a_tenth"))


def gap_prune(spark: SparkSession, d: str) -> DataFrame:
    return vectors.gap_prune(knn_exact(spark, d))


def recall_facts_budget(spark: SparkSession, d: str) -> DataFrame:
    r = vectors.recall_facts(fx.queries(spark, d), fx.facts(spark, d), fx.facts(spark, d), A, k=8, budget=80, shared=fx.vectors(spark, d))
    return r.select("query_id", "rank", "fact_id", "text", "cost", "used")


def recall_episodes(spark: SparkSession, d: str) -> DataFrame:
    n = fx.vectors(spark, d).count()
    e = fx.episodes(spark, d)
    items = e.withColumn("vec_id", F.col("episode_id") % n).join(fx.vectors(spark, d), "vec_id").select("episode_id", "group_id", "embedding")
    r = vectors.recall_episodes(fx.queries(spark, d), items, e)
    return r.select("query_id", "rank", "episode_id", "score", "session_id", "source", stamp("event_time"), F.length("text").cast("long").alias("n_chars"))


def _infer(spark: SparkSession, d: str, mode: str) -> DataFrame:
    f = fx.facts(spark, d)
    return inference.infer(fx.queries(spark, d), f, f, fx.episodes(spark, d), A, mode, shared=fx.vectors(spark, d))


def infer_all(spark: SparkSession, d: str) -> DataFrame:
    return _infer(spark, d, "all")


def infer_consistent(spark: SparkSession, d: str) -> DataFrame:
    return _infer(spark, d, "consistent")


def infer_conflict_set(spark: SparkSession, d: str) -> DataFrame:
    return _infer(spark, d, "conflict_set")


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = fx.facts(spark, d)
    hits, seeds = inference.seeds(fx.queries(spark, d), f, f, A, shared=fx.vectors(spark, d))
    return vectors.score_pairs(inference.seed_pairs(seeds, f, A), hits)


def verdict_requests(spark: SparkSession, d: str) -> DataFrame:
    f = fx.facts(spark, d)
    ordered = inference.order_pairs(scored_pairs(spark, d), f)
    said = fx.queries(spark, d).select("query_id", F.concat(F.lit("which of these holds, number "), F.col("query_id").cast("string"), F.lit("?")).alias("text"))
    asked = inference.verdict_requests(ordered, inference.evidence(ordered, fx.episodes(spark, d)), said, inference.attestations(ordered, fx.mutations(spark, d)))
    return asked.select("query_id", F.col("n_conflicts").cast("long").alias("n_conflicts"), "prompt")


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that state a fact in a line of their own."""
    who = F.concat(F.lit("FACT: c"), (F.col("episode_id") % 500).cast("string"), F.lit(" | said | "), F.substring("source", 5, 20))
    return fx.episodes(spark, d).withColumn("text", F.concat("text", F.lit("\n"), who, F.lit("\n")))


def remember(spark: SparkSession, d: str) -> DataFrame:
    new, pairs = inference.add_episodes(_told(spark, d), fx.facts(spark, d))
    n = pairs.select("fact_id", F.size("conflicts").cast("long").alias("n_conflicts"))
    return new.join(n, "fact_id", "left").select("fact_id", *KEY, "object", stamp("valid_at"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


def remember_commits(spark: SparkSession, d: str) -> DataFrame:
    """Episodes in two batches, of which the second comes twice and once breaks off: what the three tables hold."""
    root, told, known = new_folder(spark, "memory"), _told(spark, d), fx.facts(spark, d)
    parts = [told.filter("episode_id % 2 = 0"), told.filter("episode_id % 2 = 1")]
    commits.commit(root, 0, inference.episode_tables(parts[0], known, dim=16))
    last = inference.episode_tables(parts[1], known, dim=16)
    last["episodes"].write.parquet(f"{root}/episodes/batch=1/attempt=broken")
    commits.commit(root, 1, last)
    commits.commit(root, 1, last)
    read = lambda name, schema: commits.read_table(spark, root, name, schema)
    e, f, v = read("episodes", inference.EPISODE), read("facts", inference.FACT), read("vectors", inference.VECTOR)
    one = lambda df, name, ident, extra: df.groupBy("group_id", "batch").agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.sum(ident).alias("ids"), extra.cast("long").alias("extra"))
    out = one(e, "episodes", "episode_id", F.sum(F.length("text"))).unionByName(one(f, "facts", "fact_id", F.sum(F.size("conflicts"))))
    for kind in ("episode", "fact"):
        out = out.unionByName(one(v.filter(F.col("kind") == kind), f"vectors of {kind}s", "id", F.sum(F.size("embedding"))))
    return out


def remember_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The facts of episodes by a table function in a lateral join."""
    return inference.extract_lateral(_told(spark, d)).select("episode_id", "subject", "predicate", "object", "confidence", stamp("valid_at"))


def bfs_frontier(spark: SparkSession, d: str) -> DataFrame:
    e = fx.edges(spark, d)
    starts = e.select("gid", F.col("src").alias("start")).filter("cast(substr(start, 2) as int) % 20 = 0").distinct()
    return graph.bfs_frontier(e, starts, 2)


def parents(spark: SparkSession, d: str) -> DataFrame:
    e = fx.edges(spark, d)
    return graph.parents(e, e.select("gid", F.col("dst").alias("node")))


def graph_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.load_edges(fx.edges(spark, d))[1]


def neighbors_k(spark: SparkSession, d: str) -> DataFrame:
    f = fx.facts(spark, d)
    starts = f.filter("cast(substr(subject, 2) as int) % 20 = 0").select("group_id", F.col("subject").alias("start"))
    return graph.neighbors(f, starts, 2, A).select("group_id", "start", "rank", "fact_id")


ASOF = f"valid_at <= timestamp '{A}' and (invalid_at is null or invalid_at > timestamp '{A}')"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"
KNN = f"""items as (select f.fact_id, f.group_id, f.tier, e.embedding from facts f join embeddings e on e.vec_id = f.vec_id),
scored as (select query_id, fact_id, round(list_dot_product(q::double[], embedding::double[]) / sqrt(list_dot_product(q::double[], q::double[]) * list_dot_product(embedding::double[], embedding::double[])), 6) as score
  from queries join items on group_id = scope or scope = '*' where tier in ('T1', 'T2')),
ranked as (select *, row_number() over (partition by query_id order by score desc, fact_id) as rank from scored)"""
PRUNE = """{0}_g as (select *, score - lead(score) over (partition by query_id order by rank) as gap, first_value(score) over (partition by query_id order by rank) as top from {0}),
{0}_c as (select query_id, arg_min(rank, struct_pack(g := -gap, r := rank)) as cut from {0}_g where gap > 0 and gap >= 0.10 * top group by query_id),
{0}_kept as (select g.* from {0}_g g left join {0}_c c using (query_id) where cut is null or rank <= cut)"""
SEEDS = f"with {fx.FACTS}, {fx.QUERIES}, {KNN}, hits as (select * from ranked where rank <= 16), {PRUNE.format('hits')}, seeds as (select f.*, query_id, score, rank from hits_kept join facts f using (fact_id) where tier in ('T1', 'T2') and {ASOF})"
END = "coalesce({0}.invalid_at, timestamp '9999-12-31 23:59:59')"
OVERLAP = f"a.valid_at < {END.format('b')} and b.valid_at < {END.format('a')}"
PAIRS = f"""every_pair as (select distinct query_id, least(a.fact_id, b.fact_id) as e1, greatest(a.fact_id, b.fact_id) as e2 from seeds a join facts b using (group_id, subject, predicate)
  where b.tier in ('T1', 'T2') and b.valid_at <= timestamp '{A}' and (b.invalid_at is null or b.invalid_at > timestamp '{A}') and a.fact_id <> b.fact_id and a.object <> b.object and {OVERLAP}),
pair_s as (select query_id, e1, e2, greatest(coalesce(x.score, 0), coalesce(y.score, 0)) as score from every_pair p
  left join hits x on x.query_id = p.query_id and x.fact_id = e1 left join hits y on y.query_id = p.query_id and y.fact_id = e2),
pair_r as (select query_id, e1, e2, score, row_number() over w as rank, lead(score) over w as nxt, first_value(score) over w as best from pair_s window w as (partition by query_id order by score desc, e1, e2))"""
PAIRS = PAIRS.replace("select query_id, e1, e2, greatest", "select p.query_id, e1, e2, greatest") + f", {PRUNE.format('pair_r')}, pairs as (select query_id, e1, e2, score, rank, best, worst_kept, first_dropped from (select *, min(score) over (partition by query_id) as worst_kept, coalesce(arg_max(nxt, rank) over (partition by query_id), 0) as first_dropped from pair_r_kept) where rank <= 8)"
PAIRS = PAIRS.replace("arg_max(nxt, rank) over (partition by query_id)", "last_value(nxt) over (partition by query_id order by rank rows between unbounded preceding and unbounded following)")
ORDERED = """ordered as (select query_id, rank, case when (x.valid_at, x.fact_id) <= (y.valid_at, y.fact_id) then x else y end as o, case when (x.valid_at, x.fact_id) <= (y.valid_at, y.fact_id) then y else x end as n
  from pairs join facts x on x.fact_id = e1 join facts y on y.fact_id = e2)"""

ORACLE = {
    "facts_as_of": f"with {fx.FACTS} select fact_id, group_id, subject, predicate, object, {TS.format('valid_at')}, {TS.format('invalid_at')}, tier, pinned from facts where {ASOF} and tier in ('T1', 'T2') and group_id = '{fx.SCOPE}'",
    "facts_as_of_many": f"""with {fx.FACTS}, anchors as (select timestamp '2024-01-01' + to_days(cast(i as int)) as anchor from range(1, 29, 9) t(i))
select group_id, {TS.format('anchor')}, count(*) as n_facts, count(distinct subject) as n_subjects from facts, anchors where valid_at <= anchor and (invalid_at is null or invalid_at > anchor) group by group_id, anchor""",
    "facts_by_term": f"""with {fx.FACTS}, f as (select * from facts where {ASOF} and tier in ('T1', 'T2')), t as (select distinct unnest([subject, object, predicate]) as term, fact_id, valid_at from f),
r as (select term, fact_id, valid_at, row_number() over (partition by term order by valid_at desc, fact_id) as rank from t) select term, rank, fact_id, {TS.format('valid_at')} from r where rank <= 256""",
    "conflict_pairs": f"with {fx.FACTS} select a.group_id, a.subject, a.predicate, a.fact_id as e1, b.fact_id as e2, a.object as o1, b.object as o2 from facts a join facts b using (group_id, subject, predicate) where a.fact_id < b.fact_id and a.object <> b.object and {OVERLAP}",
    "conflicts_on_insert": f"""with {fx.FACTS} select a.fact_id, count(*) as n_conflicts, string_agg(b.fact_id::varchar, ',' order by b.fact_id) as conflicts from facts a join facts b using (group_id, subject, predicate)
where b.fact_id < a.fact_id and a.object <> b.object and (b.invalid_at is null or b.invalid_at > a.valid_at) group by a.fact_id""",
    "conflict_keys": f"with {fx.FACTS} select group_id, subject, predicate, count(*) as n_facts, count(distinct object) as n_objects from facts group by all",
    "siblings_left": f"""with {fx.FACTS}, f as (select * from facts where {ASOF}) select a.fact_id % 5 as query_id, a.fact_id, coalesce(string_agg(b.fact_id::varchar, ',' order by b.fact_id), '') as siblings
from f a left join f b on a.group_id = b.group_id and a.subject = b.subject and a.predicate = b.predicate and a.fact_id <> b.fact_id and a.object <> b.object and {OVERLAP} group by a.fact_id""",
    "entities": f"with {fx.FACTS}, n as (select group_id, unnest([subject, object]) as name, valid_at from facts), m as (select group_id, name, min(valid_at) as last_updated from n group by all) select group_id, name, {TS.format('last_updated')} from m",
    "supersessions": f"""with {fx.FACTS}, r as (select *, first_value(fact_id) over w as winner, row_number() over w as r from facts where valid_at <= timestamp '{A}' and (invalid_at is null or invalid_at > timestamp '1900-01-01')
window w as (partition by group_id, subject, predicate order by valid_at desc, fact_id)) select group_id, subject, predicate, winner, fact_id as loser from r where r > 1""",
    "supersessions_distinct": f"""with {fx.FACTS}, r as (select *, first_value(fact_id) over w as winner, first_value(object) over w as wo, row_number() over w as r from facts
where valid_at <= timestamp '{A}' and valid_at >= timestamp '2024-01-05' and (invalid_at is null or invalid_at > timestamp '2024-01-05')
window w as (partition by group_id, subject, predicate order by valid_at desc, fact_id)) select group_id, subject, predicate, winner, fact_id as loser from r where r > 1 and object <> wo""",
    "merges": f"""with {fx.FACTS}, r as (select *, first_value(fact_id) over w as winner, row_number() over w as r from facts where valid_at <= timestamp '{A}' and (invalid_at is null or invalid_at > timestamp '1900-01-01')
window w as (partition by group_id, subject, predicate order by valid_at desc, fact_id)) select group_id, subject, predicate, winner, string_agg(fact_id::varchar, ',' order by fact_id) as losers from r where r > 1 group by all""",
    "attest_fold": f"""with recursive {fx.MUTATIONS}, m as (select *, row_number() over (partition by fact_id order by ts, mutation_id) as k, count(*) over (partition by fact_id) as n from mutations where action in ('confirmed', 'corrected')),
s as (select fact_id, 0 as k, confidence, pinned from facts union all
  select s.fact_id, m.k, case when action = 'confirmed' then least(1.0::double, s.confidence + 0.2::double) else greatest(0.0::double, s.confidence - 0.4::double) end, action = 'confirmed' from s join m on m.fact_id = s.fact_id and m.k = s.k + 1),
l as (select fact_id, ts as last_attested_at, actor from m where k = n)
select s.fact_id, round(confidence, 6)::double as confidence, pinned, {TS.format('last_attested_at')}, actor as last_attested_by from s left join (select fact_id, max(k) as n from m group by fact_id) c on c.fact_id = s.fact_id left join l on l.fact_id = s.fact_id where s.k = coalesce(c.n, 0)""",
    "invalidate_fold": f"""with {fx.MUTATIONS}, p as (select fact_id, min(ts) as i, arg_max(reason, struct_pack(t := ts, m := mutation_id)) as reason, arg_max(actor, struct_pack(t := ts, m := mutation_id)) as actor from mutations where action = 'invalidate' group by fact_id),
o as (select f.fact_id, coalesce(f.invalid_at, i) as invalid_at, reason, actor from facts f left join p on p.fact_id = f.fact_id) select fact_id, {TS.format('invalid_at')}, reason as invalidate_reason, actor as invalidated_by from o""",
    "delete_facts": f"with {fx.MUTATIONS} select group_id, count(*) as n_facts, sum(fact_id)::bigint as ids from facts where fact_id not in (select fact_id from mutations where action = 'delete') group by group_id",
    "cascade_delete": f"""with {fx.FACTS}, {fx.EPISODES} select e.episode_id, coalesce(string_agg(f.fact_id::varchar, ',' order by f.fact_id), '') as removed from episodes e left join facts f on f.source_episode_id = e.episode_id where e.episode_id % 700 = 0 group by e.episode_id""",
    "cascade_facts_left": f"with {fx.FACTS}, {fx.EPISODES} select source_episode_id, count(*) as n_facts from facts where source_episode_id not in (select episode_id from episodes where episode_id % 700 = 0) group by source_episode_id",
    "unknown_mutations": f"with {fx.MUTATIONS} select mutation_id, fact_id, action from mutations where fact_id not in (select fact_id from facts where group_id <> '{fx.SCOPE}')",
    "knn_lsh_recall": f"with {fx.FACTS}, {fx.QUERIES}, {KNN} select q.scope, count(distinct q.query_id) as n_queries, count(r.fact_id) as n_exact, true as recall_holds from queries q left join (select * from ranked where rank <= 16) r using (query_id) group by q.scope",
    "knn_exact": f"with {fx.FACTS}, {fx.QUERIES}, {KNN} select query_id, fact_id, score, rank from ranked where rank <= 16",
    "gap_prune": f"with {fx.FACTS}, {fx.QUERIES}, {KNN}, hits as (select * from ranked where rank <= 16), {PRUNE.format('hits')} select query_id, fact_id, score, rank from hits_kept",
    "recall_facts_budget": f"""with {fx.FACTS}, {fx.QUERIES}, {KNN}, live as (select query_id, rank, f.fact_id, '(' || subject || ', ' || predicate || ', ' || object || ')' as text from ranked join facts f using (fact_id) where rank <= 24 and f.tier in ('T1', 'T2') and {ASOF}),
c as (select *, greatest(1, length(text) // 4)::bigint as cost from live), u as (select *, (sum(cost) over (partition by query_id order by rank))::bigint as used from c) select query_id, rank, fact_id, text, cost, used from u where used <= 80""",
    "recall_episodes": f"""with {fx.EPISODES}, {fx.QUERIES}, s as (select query_id, episode_id, e.session_id, e.source, event_time, text, round(list_dot_product(q::double[], embedding::double[]) / sqrt(list_dot_product(q::double[], q::double[]) * list_dot_product(embedding::double[], embedding::double[])), 6) as score
  from queries join episodes e on group_id = scope or scope = '*' join embeddings v on v.vec_id = episode_id % (select count(*) from embeddings)),
r as (select *, row_number() over (partition by query_id order by score desc, episode_id) as rank from s) select query_id, rank, episode_id, score, session_id, source, {TS.format('event_time')}, length(text)::bigint as n_chars from r where rank <= 5""",
    "infer_all": f"{SEEDS} select query_id, fact_id, rank, 0.5::double as confidence from seeds",
    "scored_pairs": f"{SEEDS}, {PAIRS} select * from pairs",
    "infer_consistent": f"{SEEDS}, {PAIRS} select query_id, fact_id, rank, 0.7::double as confidence from seeds where (query_id, fact_id) not in (select (query_id, e1) from pairs union all select (query_id, e2) from pairs)",
    "infer_conflict_set": f"{SEEDS}, {PAIRS}, {ORDERED} select distinct query_id, n.fact_id as fact_id from ordered union select query_id, fact_id from seeds where query_id not in (select query_id from pairs)",
    "verdict_requests": f"""{SEEDS.replace(fx.FACTS, fx.MUTATIONS)}, {PAIRS}, {ORDERED}, {fx.EPISODES},
c as (select query_id, count(*) as n_conflicts, string_agg('- #' || k || ': e1 (' || o.fact_id || ') vs e2 (' || n.fact_id || '): e1 (older): (' || o.subject || ', ' || o.predicate || ', ' || o.object || ') valid_at=' || strftime(o.valid_at, '%Y-%m-%d') || '; e2 (newer): (' || n.subject || ', ' || n.predicate || ', ' || n.object || ') valid_at=' || strftime(n.valid_at, '%Y-%m-%d'), chr(10) order by rank) as lines from (select *, row_number() over (partition by query_id order by rank) as k from ordered) group by query_id),
notes as (select query_id, string_agg('- fact ' || fact_id || ' ' || action || ' by ' || actor || ' on ' || strftime(ts, '%Y-%m-%d'), chr(10) order by ts, mutation_id) as notes from (select distinct query_id, unnest([o.fact_id, n.fact_id]) as fact_id from ordered) join mutations using (fact_id) where action in ('confirmed', 'corrected') group by query_id),
i as (select distinct query_id, unnest([o.source_episode_id, n.source_episode_id]) as episode_id from ordered),
s as (select query_id, string_agg('- [' || strftime(event_time, '%Y-%m-%d') || '] ' || case when length(text) > 300 then text[:299] || '…' else text end, chr(10) order by episode_id) as shown from i join episodes using (episode_id) group by query_id)
select query_id, n_conflicts, concat_ws(chr(10) || chr(10), '{inference.INSTRUCTIONS}', 'Question:' || chr(10) || 'which of these holds, number ' || query_id || '?', 'Conflicts:' || chr(10) || lines, 'Attestations:' || chr(10) || notes, 'Episodes:' || chr(10) || shown) as prompt from c left join s using (query_id) left join notes using (query_id)""",
    "remember": f"""with {fx.FACTS}, {fx.EPISODES}, n as (select (select max(fact_id) + 1 from facts) + episode_id * 1000 + 1 as fact_id, group_id, 'c' || (episode_id % 500) as subject, 'said' as predicate, source[5:] as object, event_time as valid_at from episodes),
c as (select a.fact_id, count(*) as k from n a join n b using (group_id, subject, predicate) where b.fact_id < a.fact_id and a.object <> b.object group by a.fact_id)
select fact_id, group_id, subject, predicate, object, {TS.format('valid_at')}, coalesce(k, 0) as n_conflicts from n left join c using (fact_id)""",
    "remember_commits": f"""with {fx.FACTS}, {fx.EPISODES}, n as (select (select max(fact_id) + 1 from facts) + episode_id * 1000 + 1 as fact_id, group_id, 'c' || (episode_id % 500) as subject, 'said' as predicate, source[5:] as object, episode_id % 2 as batch from episodes),
c as (select a.fact_id, count(*) as k from n a join n b using (group_id, subject, predicate, batch) where b.fact_id < a.fact_id and a.object <> b.object group by a.fact_id),
e as (select episode_id, group_id, episode_id % 2 as batch, text || chr(10) || 'FACT: c' || (episode_id % 500) || ' | said | ' || source[5:] || chr(10) as t from episodes)
select group_id, batch, 'episodes' as what, count(*) as n, sum(episode_id)::bigint as ids, sum(length(t))::bigint as extra from e group by group_id, batch
union all select group_id, batch, 'facts', count(*), sum(fact_id)::bigint, sum(coalesce(k, 0))::bigint from n left join c using (fact_id) group by group_id, batch
union all select group_id, batch, 'vectors of episodes', count(*), sum(episode_id)::bigint, 16 * count(*) from e group by group_id, batch
union all select group_id, batch, 'vectors of facts', count(*), sum(fact_id)::bigint, 16 * count(*) from n group by group_id, batch""",
    "remember_lateral": f"with {fx.EPISODES} select episode_id, 'c' || (episode_id % 500) as subject, 'said' as predicate, source[5:] as object, 0.9::double as confidence, {TS.format('event_time').replace('as event_time', 'as valid_at')} from episodes",
    "bfs_frontier": f"""with {fx.EDGES}, starts as (select distinct gid, src as start from edges where cast(substr(src, 2) as int) % 20 = 0),
d1 as (select distinct s.gid, start, dst as node from starts s join edges e on e.gid = s.gid and e.src = s.start where dst <> start),
d2 as (select distinct d1.gid, start, dst as node from d1 join edges e on e.gid = d1.gid and e.src = d1.node where dst <> start)
select gid, start, node from d2 where (gid, start, node) not in (select (gid, start, node) from d1)""",
    "parents": f"with {fx.EDGES} select distinct gid, dst as node, src as parent from edges where src <> dst",
    "graph_sizes": f"with {fx.EDGES} select gid, count(distinct node) as n_nodes, (select count(*) from edges) as n_edges from (select gid, unnest([src, dst]) as node from edges) group by gid",
    "neighbors_k": f"""with {fx.FACTS}, live as (select * from facts where {ASOF} and tier in ('T1', 'T2')), ways as (select group_id, subject as node, object as nxt, fact_id, valid_at from live union all select group_id, object, subject, fact_id, valid_at from live),
starts as (select distinct group_id, subject as start from facts where cast(substr(subject, 2) as int) % 20 = 0), s1 as (select distinct w.group_id, start, nxt, fact_id, valid_at from starts s join ways w on w.group_id = s.group_id and w.node = s.start),
s2 as (select distinct w.group_id, start, w.fact_id, w.valid_at from (select distinct group_id, start, nxt from s1) s join ways w on w.group_id = s.group_id and w.node = s.nxt),
a as (select group_id, start, fact_id, valid_at from s1 union select * from s2), r as (select *, row_number() over (partition by group_id, start order by valid_at desc, fact_id) as rank from a) select group_id, start, rank, fact_id from r where rank <= 256""",
}
QUERIES = {f.__name__: f for f in (facts_as_of, facts_as_of_many, facts_by_term, conflict_pairs, conflicts_on_insert, conflict_keys, siblings_left, entities, supersessions, supersessions_distinct, merges, attest_fold, invalidate_fold, delete_facts, cascade_delete, cascade_facts_left, unknown_mutations, knn_exact, knn_lsh, knn_lsh_recall, knn_coarse, knn_coarse_recall, gap_prune, recall_facts_budget, recall_episodes, infer_all, infer_consistent, infer_conflict_set, scored_pairs, verdict_requests, remember, remember_commits, remember_lateral, bfs_frontier, parents, graph_sizes, neighbors_k)}
