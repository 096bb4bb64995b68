"""Answers to questions over contradicting facts, for a whole table of questions at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.storage import stored
from factloom.functions.text import strip
from factloom.functions.tokens import ELLIPSIS
from factloom.operators.temporal import OPEN_END, conflicts_on_insert, holds_at, tier_filter
from factloom.operators.vectors import embed, fact_text, gap_prune, hydrate_ranked, knn, score_pairs
from factloom.schemas import RESOLUTIONS

MAX_CONFLICTS = 8


def seeds(queries: DataFrame, items: DataFrame, facts: DataFrame, anchor: str, max_hops: int = 4, tiers: Sequence[str] = ("T1", "T2"), shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all hits, hydrated seeds): nearest facts of the tenant, pruned by gap before any join with facts; ``shared`` as in :func:`knn`."""
    hits = stored(knn(queries, items, max(max_hops * 4, 16), tiers=tiers, shared=shared), "hits")  # used several times
    return hits, stored(hydrate_ranked(gap_prune(hits), facts, anchor, tiers), "seeds")


def seed_pairs(seed_rows: DataFrame, facts: DataFrame, anchor: str, tiers: Sequence[str] = ("T1", "T2")) -> DataFrame:
    """(query_id, e1, e2) with e1 < e2: seeds and the facts that contradict them, each pair once a query."""
    end = F.coalesce("invalid_at", F.lit(OPEN_END).cast("timestamp"))
    key = ["group_id", "subject", "predicate"]
    s = seed_rows.select("query_id", *key, "fact_id", "object", F.col("valid_at").alias("b"), end.alias("x"))
    live = tier_filter(facts, tiers).filter(holds_at(anchor))
    o = live.select(*key, F.col("fact_id").alias("other"), F.col("object").alias("o_object"), F.col("valid_at").alias("ob"), end.alias("ox"))
    both = s.join(o.hint("merge"), key).filter("other <> fact_id and o_object <> object and b < ox and ob < x")
    return both.select("query_id", F.least("fact_id", "other").alias("e1"), F.greatest("fact_id", "other").alias("e2")).distinct()


def answer_all(seed_rows: DataFrame) -> DataFrame:
    return seed_rows.select("query_id", "fact_id", "rank", F.lit(0.5).alias("confidence"))


def answer_consistent(seed_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Seeds outside all kept pairs. A pruned or capped pair does not exclude its facts; pass all pairs to be strict."""
    hit = pairs.select("query_id", F.explode(F.array("e1", "e2")).alias("fact_id")).distinct()
    return seed_rows.join(hit.hint("merge"), ["query_id", "fact_id"], "left_anti").select("query_id", "fact_id", "rank", F.lit(0.7).alias("confidence"))


def order_pairs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs with the older fact first and a reason that states both: (query_id, e1, e2, reason, episodes, rank)."""
    f = lambda e: facts.select(F.col("fact_id").alias(e), F.struct("valid_at", F.col("fact_id").alias("id"), "subject", "predicate", "object", "source_episode_id").alias(f"f_{e}")).hint("merge")
    both = pairs.join(f("e1"), "e1").join(f("e2"), "e2")
    old, new = F.least("f_e1", "f_e2").alias("old"), F.greatest("f_e1", "f_e2").alias("new")
    both = both.select("query_id", "rank", old, new)
    say = lambda x: F.format_string("(%s, %s, %s) valid_at=%s", f"{x}.subject", f"{x}.predicate", f"{x}.object", F.date_format(f"{x}.valid_at", "yyyy-MM-dd"))
    reason = F.concat(F.lit("e1 (older): "), say("old"), F.lit("; e2 (newer): "), say("new"))
    return both.select("query_id", "rank", F.col("old.id").alias("e1"), F.col("new.id").alias("e2"), reason.alias("reason"), F.array("old.source_episode_id", "new.source_episode_id").alias("episodes"))


def evidence(ordered: DataFrame, episodes: DataFrame, most: int = 300) -> DataFrame:
    """(query_id, episode_id, snippet): the pairs' source episodes, once a query."""
    ids = ordered.select("query_id", F.explode("episodes").alias("episode_id")).distinct()
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit(ELLIPSIS))).otherwise(text)
    said = F.concat(F.lit("["), F.date_format("event_time", "yyyy-MM-dd"), F.lit("] "), body)
    return ids.join(episodes.hint("merge"), "episode_id").select("query_id", "episode_id", said.alias("snippet"))


def attestations(ordered: DataFrame, mutations: DataFrame) -> DataFrame:
    """(query_id, notes): what was confirmed or corrected of the pairs' facts, in the order of time, once a query."""
    ids = ordered.select("query_id", F.explode(F.array("e1", "e2")).alias("fact_id")).distinct()
    acts = mutations.filter(F.col("action").isin("confirmed", "corrected"))
    said = F.format_string("fact %s %s by %s on %s", "fact_id", "action", F.coalesce("actor", F.lit("unknown")), F.date_format("ts", "yyyy-MM-dd"))
    met = ids.hint("merge").join(acts.select("fact_id", "ts", "mutation_id", said.alias("note")), "fact_id")
    return met.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "mutation_id", "note"))), lambda x: x["note"]).alias("notes"))


INSTRUCTIONS = """Facts that contradict each other were found for a question. Say which of each pair holds, from dates, sources and what was confirmed.
Without enough evidence answer "unresolved" rather than guess.
Answer in JSON: thinking, resolution (e1_correct, e2_correct, both_partial or unresolved), reason (one sentence), confidence (0 to 1)."""


def verdict_requests(ordered: DataFrame, snippets: DataFrame, queries: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """One row a query: its conflicts, at most eight, in rank order, its snippets by episode, and the prompt.

    The prompt has the instructions, the text of ``queries(query_id, text)``, the numbered conflicts with the ids of both
    facts, and, where there are any, attestations of ``notes(query_id, notes)`` and episodes. More than eight conflicts
    are an error, and no prompt is made.
    """
    c = ordered.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "e1", "e2", "reason"))).alias("c"))
    s = snippets.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("episode_id", "snippet"))), lambda x: x["snippet"]).alias("s"))
    both = c.join(s.hint("merge"), "query_id", "left")
    none = F.lit(None)
    both = both.withColumn("q", none.cast("string")) if queries is None else both.join(queries.select("query_id", F.col("text").alias("q")).hint("merge"), "query_id", "left")
    both = both.withColumn("notes", none.cast("array<string>")) if notes is None else both.join(notes.hint("merge"), "query_id", "left")
    shown = F.transform("c", lambda x, i: F.format_string("- #%s: e1 (%s) vs e2 (%s): %s", i + 1, x["e1"], x["e2"], x["reason"]))
    listed = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")))
    prompt = F.concat_ws("\n\n", F.lit(INSTRUCTIONS), F.concat(F.lit("Question:\n"), F.col("q")), F.concat(F.lit("Conflicts:\n"), F.array_join(shown, "\n")), listed("Attestations", F.col("notes")), listed("Episodes", F.col("s")))
    n, few = F.size("c"), F.size("c") <= MAX_CONFLICTS
    return both.select("query_id", n.alias("n_conflicts"), F.transform("c", lambda x: x["reason"]).alias("reasons"), F.when(few, prompt).alias("prompt"), F.when(~few, "too many conflicts").alias("error"))


VERDICT = "thinking string, resolution string, reason string, confidence double"


def newest_wins(requests: DataFrame) -> DataFrame:
    """The verdict without a model: the newer fact is right."""
    return requests.select("query_id", F.lit('{"resolution": "e2_correct", "reason": "newest wins", "confidence": 1.0}').alias("response"))


def apply_verdicts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(query_id, resolution, reason, confidence, error) from JSON responses; what breaks the schema is an error."""
    r = responses.withColumn("v", F.from_json("response", VERDICT, {"mode": "PERMISSIVE"}))
    out = requests.select("query_id").join(r.hint("merge"), "query_id", "left")
    good = F.col("v.resolution").isin(*RESOLUTIONS) & F.col("v.confidence").between(0.0, 1.0)
    ok = F.coalesce(good, F.lit(False))
    return out.select("query_id", F.when(ok, F.col("v.resolution")).alias("resolution"), F.when(ok, F.col("v.reason")).alias("reason"), F.when(ok, F.col("v.confidence")).alias("confidence"), F.when(~ok, "bad response").alias("error"))


def answer_facts(seed_rows: DataFrame, ordered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, fact_id): the older facts, the newer ones, or both, as the verdict says; seeds where nothing conflicts."""
    side: Column = F.when(F.col("resolution") == "e1_correct", F.array("e1")).when(F.col("resolution") == "e2_correct", F.array("e2")).otherwise(F.array("e1", "e2"))
    judged = ordered.join(verdicts.select("query_id", "resolution").hint("merge"), "query_id").select("query_id", F.explode(side).alias("fact_id"))
    calm = seed_rows.join(ordered.select("query_id").distinct().hint("merge"), "query_id", "left_anti").select("query_id", "fact_id")
    return judged.union(calm).distinct()


def infer(queries: DataFrame, items: DataFrame, facts: DataFrame, episodes: DataFrame, anchor: str, mode: str = "all", judge: Callable[[DataFrame], DataFrame] = newest_wins, strict: bool = False, shared: DataFrame | None = None) -> DataFrame:
    """(query_id, fact_id, ...) by mode ``all``, ``consistent`` or ``conflict_set``; one verdict a query at most."""
    hits, found = seeds(queries, items, facts, anchor, shared=shared)
    if mode == "all":
        return answer_all(found)
    every = seed_pairs(found, facts, anchor)
    pairs = stored(score_pairs(every, hits, MAX_CONFLICTS), "scored-pairs")
    if mode == "consistent":
        return answer_consistent(found, every if strict else pairs)
    ordered = order_pairs(pairs, facts)
    asked = verdict_requests(ordered, evidence(ordered, episodes))
    return answer_facts(found, ordered, apply_verdicts(asked, judge(asked)))


FACT_LINES = r"(?m)^FACT: *([^|\n]+?) *\| *([^|\n]+?) *\| *([^|\n]+?) *$"


def extract_facts(episodes: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(episode_id, subject, predicate, object, confidence, valid_at) from texts.

    ``fn`` maps episodes to (episode_id, response), JSON with ``facts`` of s, p, o and confidence; a broken response
    gives no facts. By default lines ``FACT: s | p | o`` are read.
    """
    if fn is None:
        found = F.regexp_extract_all("text", F.lit(r"(?m)^FACT:[^\n]*$"), F.lit(0))
        rows = episodes.select("episode_id", "event_time", F.explode(found).alias("line"))
        part = lambda i: F.regexp_extract("line", FACT_LINES, i)
        out = rows.select("episode_id", part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"), F.lit(0.9).alias("confidence"), F.col("event_time").alias("valid_at"))
        return out.filter("subject <> ''")
    said = fn(episodes).select("episode_id", F.from_json("response", "facts array<struct<s:string,p:string,o:string,confidence:double>>").alias("r"))
    rows = episodes.select("episode_id", "event_time").join(said.hint("merge"), "episode_id").select("episode_id", "event_time", F.explode("r.facts").alias("f"))
    rows = rows.filter("f.s is not null and f.p is not null and f.o is not null and f.confidence between 0 and 1")
    return rows.select("episode_id", F.col("f.s").alias("subject"), F.col("f.p").alias("predicate"), F.col("f.o").alias("object"), F.col("f.confidence").alias("confidence"), F.col("event_time").alias("valid_at"))


class FactLines:
    """A table function: (subject, predicate, object) of each line ``FACT: s | p | o`` of a text, one row a line."""

    def eval(self, text: str | None):  # noqa: ANN201
        for line in (text or "").split("\n"):
            parts = [p.strip(" ") for p in line.removeprefix("FACT:").split("|")]
            if line.startswith("FACT:") and len(parts) == 3 and all(parts):
                yield tuple(parts)


def register_extractor(spark: SparkSession, name: str = "extract_facts", handler: type = FactLines) -> None:
    """Make a handler with ``eval(text)`` known to SQL, for ``... , lateral extract_facts(text)``.

    The handler runs where the episode's row is: once for each text, for all facts that it yields.
    """
    spark.udtf.register(name, F.udtf(handler, returnType="subject string, predicate string, object string"))


def extract_lateral(episodes: DataFrame, handler: type = FactLines) -> DataFrame:
    """The facts of :func:`extract_facts` by a table function in a lateral join."""
    register_extractor(episodes.sparkSession, "_extract_facts", handler)
    sql = "select episode_id, f.subject, f.predicate, f.object, 0.9d as confidence, event_time as valid_at from {rows} e, lateral _extract_facts(e.text) f"
    return episodes.sparkSession.sql(sql, rows=episodes.select("episode_id", "event_time", "text"))


#: Episodes longer than this are kept and embedded, but no facts are extracted from them.
LARGE_PAYLOAD = 30_000


def large_payload_split(episodes: DataFrame, most: int = LARGE_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """(episodes to extract facts from, episodes that are too long for it)."""
    large = F.length(F.coalesce("text", F.lit(""))) > most
    return episodes.filter(~large), episodes.filter(large)


def add_episodes(episodes: DataFrame, known: DataFrame, asserted: DataFrame | None = None, extract: Callable[[DataFrame], DataFrame] | None = None, tier: str = "T2") -> tuple[DataFrame, DataFrame]:
    """(new facts, their conflicts) of a batch of episodes.

    ``asserted(episode_id, subject, predicate, object, confidence)`` stands for its episodes' facts, which are then not
    extracted. New facts get ids after the known ones, in the order of their episodes; each is compared with all that
    came before it.
    """
    small, _ = large_payload_split(episodes)
    if asserted is not None:
        small = small.join(asserted.select("episode_id").distinct(), "episode_id", "left_anti")
    found = extract_facts(small, extract)
    if asserted is not None:
        given = asserted.join(episodes.select("episode_id", F.col("event_time").alias("valid_at")), "episode_id")
        found = found.unionByName(given.select(found.columns))
    found = stored(found, "found-facts")
    base = known.agg(F.coalesce(F.max("fact_id"), F.lit(-1)) + 1).first()[0]
    # Ids are offsets of episodes plus places inside them, so no global sort is needed; an offset is as wide as the episode
    # with the most facts asks.
    most = found.groupBy("episode_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    width = max(1000, most + 1)
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("subject", "predicate", "object"))
    new = found.withColumn("_n", place).join(episodes.select("episode_id", "group_id", "session_id").hint("merge"), "episode_id")
    new = new.select(
        (F.lit(base) + F.col("episode_id") * width + F.col("_n")).alias("fact_id"), "group_id", "subject", "predicate", "object", "valid_at",
        F.lit(None).cast("timestamp").alias("invalid_at"), F.lit(tier).alias("tier"), "confidence", F.lit(False).alias("pinned"), F.col("episode_id").alias("source_episode_id"), "session_id",
    )
    new = stored(new, "new-facts")  # what is returned and what is compared are the same, and the join below knows its size
    every = known.select("fact_id", "group_id", "subject", "predicate", "object", "invalid_at").unionByName(new.select("fact_id", "group_id", "subject", "predicate", "object", "invalid_at"))
    return new, conflicts_on_insert(new, every)


#: What an ingested batch is made of, as stored.
EPISODE = "episode_id long, group_id string, session_id string, source string, text string, event_time timestamp"
FACT = "fact_id long, group_id string, subject string, predicate string, object string, valid_at timestamp, invalid_at timestamp, tier string, confidence double, pinned boolean, source_episode_id long, session_id string, conflicts array<long>"
VECTOR = "kind string, id long, group_id string, embedding array<float>"


def episode_tables(episodes: DataFrame, known: DataFrame, dim: int = 64, model: Callable | None = None, **how: object) -> dict[str, DataFrame]:
    """The three tables of a batch of episodes: ``episodes``, ``facts`` with what they contradict, and ``vectors`` of all
    episodes' texts, large ones too, and of all new facts. What embeds and extracts can be exchanged."""
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    episodes = stored(episodes.select(*names(EPISODE)), "episodes")
    new, pairs = add_episodes(episodes, known, **how)
    facts = new.join(pairs.hint("merge"), "fact_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<long>")))
    said = episodes.select(F.lit("episode").alias("kind"), F.col("episode_id").alias("id"), "group_id", "text")
    said = said.unionByName(new.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), "group_id", fact_text().alias("text")))
    return {"episodes": episodes, "facts": facts.select(*names(FACT)), "vectors": embed(said, "text", dim, model).select(*names(VECTOR))}


def reformulated(queries: DataFrame, fn: Column | None = None) -> DataFrame:
    """Queries as a model rewords them; an empty or missing answer leaves the query as it is."""
    said = F.lit(None).cast("string") if fn is None else fn
    return queries.withColumn("retrieval_query", F.coalesce(F.nullif(strip(said), F.lit("")), F.col("query")))
