"""Virtualising conversations: atomic groups of turns, token budgets, recalled history and the recap text.

One row of ``messages(conv_id, msg_idx, role, text, pure_tool_result)`` is one message. All windows and aggregates share
the partitioning by conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import rstrip, strip
from factloom.functions.tokens import approx_tokens, cut, tokens_or_one, truncate_to_tokens
from factloom.operators.vectors import cosine

MARGIN, LAST_K, RECALL_K = 1024, 4, 16
VERBATIM_PART, SUMMARY_PART, LEAST_RECAP = 0.70, 0.25, 256
NEEDLE = r"\b[A-Za-z][A-Za-z0-9_-]{7,}\b"
# The recap's own text.
VERBATIM_HEAD = "Earlier turns, word for word:\n"
SUMMARY_HEAD = "Earlier turns, in short:\n"
RECALL_HEAD = "Known facts:\n"
RECAP_OPEN = "\n\n<recalled_memory>\nWhat follows was left out of the visible messages. It is part of this conversation.\n\n"
RECAP_CLOSE = "\n</recalled_memory>"
HISTORY_HEAD = "Turns recalled from before, in their original order:"


def ordered_text(part: Column, order: list[str], sep: str) -> Column:
    """Aggregate: the parts joined in the order of columns."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, part.alias("_part")))), lambda x: x["_part"]), sep)


def atomic_groups(messages: DataFrame) -> DataFrame:
    """Add ``group_no``: a group starts at each user message that is not all tool results; leading rows are group 0."""
    order = Window.partitionBy("conv_id").orderBy("msg_idx")
    starts = ((F.col("role") == "user") & ~F.col("pure_tool_result")).cast("long")
    first = F.row_number().over(order) == 1
    running = F.sum(F.when(first, F.lit(1)).otherwise(starts)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("group_no", running - 1)


def last_user_query(messages: DataFrame) -> DataFrame:
    """(conv_id, query): the latest user message that is not all tool results."""
    said = messages.filter("role = 'user' and not pure_tool_result")
    return said.groupBy("conv_id").agg(F.max_by("text", "msg_idx").alias("query"))


def outcomes(messages: DataFrame, limit: Column | int, margin: int = MARGIN, last_k: int = LAST_K) -> DataFrame:
    """(conv_id, counts, tokens, outcome, budgets): what becomes of each conversation.

    fits: all messages are within the limit less the margin. degraded: even the last groups are not. virtualized: the last
    groups stay and the rest of the budget goes to the recap, most of it to recalled turns.
    """
    m = atomic_groups(messages).withColumn("tokens", approx_tokens(F.col("text")))
    top = F.max("group_no").over(Window.partitionBy("conv_id"))
    m = m.withColumn("hot", F.col("group_no") > top - max(1, last_k))
    sum_if = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0))
    per = m.groupBy("conv_id").agg(
        F.count("*").alias("original_messages"),
        F.sum("tokens").alias("original_tokens"),
        F.count_if("hot").alias("hot_messages"),
        sum_if(F.col("hot")).alias("hot_tokens"),
        sum_if(~F.col("hot")).alias("cold_tokens"),
        F.count_distinct(F.when(~F.col("hot"), F.col("group_no"))).alias("cold_groups"),
    )
    room = (F.lit(limit) if isinstance(limit, int) else limit) - margin
    per = per.withColumn("room", room.cast("long"))
    per = per.withColumn("outcome", F.when(F.col("original_tokens") <= F.col("room"), "fits").when(F.col("hot_tokens") > F.col("room"), "degraded").otherwise("virtualized"))
    recap = F.greatest(F.lit(LEAST_RECAP), F.col("room") - F.col("hot_tokens"))
    cold = F.col("cold_groups") > 0
    per = per.withColumn("recap_budget", F.when(F.col("outcome") == "virtualized", recap))
    per = per.withColumn("verbatim_budget", F.when(cold, F.floor(F.col("recap_budget") * VERBATIM_PART)).otherwise(F.col("recap_budget") * 0).cast("long"))
    per = per.withColumn("summary_budget", F.when(cold, F.floor((F.col("recap_budget") - F.col("verbatim_budget")) * SUMMARY_PART)).otherwise(F.col("recap_budget") * 0).cast("long"))
    left = F.when(F.col("outcome") == "fits", F.col("room") - F.col("original_tokens")).otherwise(F.col("recap_budget") - F.col("verbatim_budget") - F.col("summary_budget"))
    return per.withColumn("recall_budget", F.when(F.col("outcome") != "degraded", F.greatest(F.lit(LEAST_RECAP), left)))


def cold_messages(messages: DataFrame, per_conv: DataFrame, last_k: int = LAST_K) -> DataFrame:
    """Messages before the last groups, of the conversations that are virtualized; the others leave before any ranking."""
    some = per_conv.filter("outcome = 'virtualized'").select("conv_id")
    m = atomic_groups(messages.join(some, "conv_id", "left_semi"))
    top = F.max("group_no").over(Window.partitionBy("conv_id"))
    return m.withColumn("_top", top).filter(F.col("group_no") <= F.col("_top") - max(1, last_k)).drop("_top")


def cold_summary(cold: DataFrame, most: int = 280) -> DataFrame:
    """(conv_id, summary): a line for each cold message, newlines as spaces, cut to ``most`` characters."""
    line = F.concat(F.lit("- ["), "role", F.lit("] "), cut(F.translate(strip(F.coalesce("text", F.lit(""))), "\n", " "), most))
    return cold.groupBy("conv_id").agg(ordered_text(line, ["msg_idx"], "\n").alias("summary"))


def group_blocks(cold: DataFrame) -> DataFrame:
    """(conv_id, group_no, block, body): each group as numbered turns, and its bare text for matching."""
    place = F.row_number().over(Window.partitionBy("conv_id", "group_no").orderBy("msg_idx")) - 1
    rows = cold.withColumn("j", place)
    turn = F.concat(F.lit("[turn "), F.col("group_no").cast("string"), F.lit("."), F.col("j").cast("string"), F.lit(" "), "role", F.lit("]\n"), F.coalesce("text", F.lit("")))
    return rows.groupBy("conv_id", "group_no").agg(ordered_text(turn, ["j"], "\n").alias("block"), ordered_text(F.coalesce("text", F.lit("")), ["j"], "\n").alias("body"))


def embedding_input(cold: DataFrame, most: int = 4000) -> DataFrame:
    """(conv_id, group_no, text): messages with roles, each cut to its share, the whole cut to ``most`` characters."""
    size = Window.partitionBy("conv_id", "group_no")
    share = F.greatest(F.lit(200), F.floor(F.lit(most) / F.count("*").over(size))).cast("int")
    rows = cold.withColumn("share", share)
    t = F.coalesce("text", F.lit(""))
    part = F.concat(F.lit("["), "role", F.lit("] "), F.when(F.length(t) > F.col("share"), F.concat(F.left(t, F.col("share")), F.lit("…"))).otherwise(t))
    return rows.groupBy("conv_id", "group_no").agg(F.left(ordered_text(part, ["msg_idx"], "\n"), F.lit(most)).alias("text"))


def needles(text: Column) -> Column:
    """Lower-cased identifiers of a query: long tokens with a digit, a dash or an underscore."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NEEDLE), F.lit(0))
    return F.transform(F.filter(found, lambda t: t.rlike("[0-9_-]")), lambda t: F.lower(t))


def literal_groups(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """(conv_id, group_no) of groups whose text contains a needle of the conversation's query."""
    q = queries.select("conv_id", needles(F.col("query")).alias("needles")).filter(F.size("needles") > 0)
    low = F.lower("body")
    return groups.join(q, "conv_id").filter(F.exists("needles", lambda n: F.contains(low, n))).select("conv_id", "group_no")


def rank_cold_groups(groups: DataFrame, literal: DataFrame, vectors: DataFrame | None = None, k: int = RECALL_K) -> DataFrame:
    """(conv_id, group_no, rank): literal hits in turn order, then the nearest groups that are not among them.

    ``vectors(conv_id, group_no, embedding, q)``; without it only literal hits are ranked.
    """
    hits = literal.select("conv_id", "group_no", F.lit(0).alias("path"), F.lit(0.0).alias("far"))
    if vectors is not None:
        n = literal.groupBy("conv_id").agg(F.count("*").alias("n_literal"))
        s = vectors.withColumn("far", -F.round(cosine(F.col("embedding"), F.col("q")), 6)).join(n, "conv_id", "left")
        by = Window.partitionBy("conv_id").orderBy("far", "group_no")
        near = s.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= F.lit(k) + F.coalesce("n_literal", F.lit(0)))
        hits = hits.unionByName(near.select("conv_id", "group_no", F.lit(1).alias("path"), "far"))
    first = hits.groupBy("conv_id", "group_no").agg(F.min(F.struct("path", "far")).alias("p"))
    order = Window.partitionBy("conv_id").orderBy("p.path", "p.far", "group_no")
    return first.withColumn("rank", F.row_number().over(order)).select("conv_id", "group_no", "rank")


def render_groups(ranked: DataFrame, groups: DataFrame, budgets: DataFrame) -> DataFrame:
    """(conv_id, history): the best groups within the budget, the first always, in their original order."""
    r = ranked.join(groups, ["conv_id", "group_no"]).join(budgets.select("conv_id", "verbatim_budget"), "conv_id")
    r = r.filter("verbatim_budget > 0").withColumn("cost", tokens_or_one(F.col("block")) + 2)
    order = Window.partitionBy("conv_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = r.withColumn("used", F.sum("cost").over(order)).filter("used <= verbatim_budget or rank = 1")
    body = ordered_text(F.col("block"), ["group_no"], "\n\n")
    return kept.groupBy("conv_id").agg(F.concat(F.lit(HISTORY_HEAD + "\n\n"), rstrip(body)).alias("history"), F.count("*").alias("groups_shown"))


def assemble_recap(summary: Column, recalled: Column, history: Column) -> Column:
    """The memory block: history, summary and recalled knowledge, those that are there; empty if none is."""
    some = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    body = F.concat_ws("\n\n", some(VERBATIM_HEAD, strip(history)), some(SUMMARY_HEAD, summary), some(RECALL_HEAD, strip(recalled)))
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(RECAP_OPEN), body, F.lit(RECAP_CLOSE)))


Recall = Callable[[DataFrame], DataFrame]


def virtualize(
    messages: DataFrame, limit: int, margin: int = MARGIN, last_k: int = LAST_K, vectors: DataFrame | Recall | None = None, recalled: DataFrame | Recall | None = None,
    summary_chars: int = 280, requests: DataFrame | None = None, recall_k: int = RECALL_K,
) -> DataFrame:
    """One row per conversation: the outcome, its budgets, the recap, the system text with it, and the report's counters.

    ``recalled(conv_id, recall_text)`` is knowledge from elsewhere within the recall budget, or a function that makes it
    from (conv_id, query, recall_budget). ``vectors(conv_id, group_no, embedding, q)`` ranks cold groups beside literal hits,
    or is a function of the groups. ``requests(conv_id, system, tools_tokens)`` is what goes out with the messages; it has
    no part in the budget. A virtualized conversation whose recap would be empty passes through unchanged.
    """
    per = outcomes(messages, limit, margin, last_k)
    cold = cold_messages(messages, per, last_k)
    groups = group_blocks(cold)
    query = last_user_query(messages)
    vectors = vectors(groups) if callable(vectors) else vectors
    history = render_groups(rank_cold_groups(groups, literal_groups(query, groups), vectors, recall_k), groups, per)
    if callable(recalled):
        recalled = recalled(per.join(query, "conv_id", "left").filter("outcome <> 'degraded'").select("conv_id", F.coalesce("query", F.lit("")).alias("query"), "recall_budget"))
    out = per.join(query, "conv_id", "left").join(history, "conv_id", "left").join(cold_summary(cold, summary_chars), "conv_id", "left")
    out = out.join(recalled, "conv_id", "left") if recalled is not None else out.withColumn("recall_text", F.lit(None).cast("string"))
    short = truncate_to_tokens(F.col("summary"), F.col("summary_budget") + F.col("verbatim_budget"))
    out = out.withColumn("summary", F.when(F.col("history").isNull() & F.col("summary").isNotNull(), short))
    use = F.col("outcome") != "degraded"
    out = out.withColumn("recap", F.when(use, assemble_recap(F.col("summary"), F.col("recall_text"), F.col("history"))).otherwise(""))
    out = out.withColumn("recap_tokens", approx_tokens(F.col("recap")))
    asked = out.join(requests.select("conv_id", "system", "tools_tokens"), "conv_id", "left") if requests is not None else out.withColumns({"system": F.lit(""), "tools_tokens": F.lit(0)})
    asked = asked.withColumns({"system": F.coalesce("system", F.lit("")), "tools_tokens": F.coalesce("tools_tokens", F.lit(0)).cast("long")})
    return asked.withColumns({"system_tokens": approx_tokens(F.col("system")), "system": F.concat("system", "recap")}).withColumn("post_system_tokens", approx_tokens(F.col("system")))


def report(virtualized: DataFrame) -> DataFrame:
    """The counters of each conversation, with what goes out."""
    on = (F.col("outcome") == "virtualized") & (F.col("recap") != "")
    kept = F.when(F.col("outcome") == "fits", F.col("original_messages")).otherwise(F.col("hot_messages"))
    sent = F.when(on, F.col("hot_tokens")).otherwise(F.col("original_tokens"))
    cold = F.when(F.col("outcome") == "fits", 0).otherwise(F.col("cold_groups"))
    size = lambda before, c, after: F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after))
    notes = F.concat_ws(
        "; ",
        F.when(F.col("outcome") == "degraded", size("the last groups alone take ", "hot_tokens", " tokens")),
        F.when((F.col("outcome") == "virtualized") & ~on, "nothing to recall, passed through"),
        F.when(on, size("recap of ", "cold_groups", " groups")),
        F.when((F.col("outcome") == "fits") & (F.col("recap") != ""), "fits, with recalled facts"),
    )
    return virtualized.select(
        "conv_id",
        "outcome",
        "original_messages",
        "original_tokens",
        (F.col("original_tokens") + F.col("system_tokens") + F.col("tools_tokens")).alias("original_total_tokens"),
        kept.alias("kept_messages"),
        F.when(F.col("outcome") == "fits", F.col("original_tokens")).otherwise(F.col("hot_tokens")).alias("kept_tokens"),
        cold.cast("long").alias("cold_groups"),
        F.when(F.col("outcome") == "fits", 0).otherwise(F.col("cold_tokens")).cast("long").alias("cold_tokens"),
        "recap_tokens",
        "post_system_tokens",
        "tools_tokens",
        (sent + F.col("post_system_tokens") + F.col("tools_tokens")).alias("outbound_tokens"),
        (F.col("outcome") == "degraded").alias("degraded"),
        ((cold > 0) & (F.col("outcome") != "degraded") & (kept < F.col("original_messages"))).alias("virtualized"),
        notes.alias("notes"),
    )


def fact_lines(facts: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Facts as a list, rows with a part missing dropped: (keys, facts_text)."""
    about = F.concat_ws(", ", F.date_format("valid_at", "yyyy-MM-dd'T'HH:mm:ss"), F.nullif("tier", F.lit("")), F.when(F.col("confidence").isNotNull(), F.format_string("c=%.2f", "confidence")))
    line = F.concat(F.format_string("- **%s** %s **%s**", "subject", "predicate", "object"), F.when(about == "", "").otherwise(F.concat(F.lit("  _("), about, F.lit(")_"))))
    whole = facts.filter("subject <> '' and predicate <> '' and object <> ''")
    return whole.groupBy(*keys).agg(ordered_text(line, [rank], "\n").alias("facts_text"))


def episode_snippets(episodes: DataFrame, keys: list[str], budget: int, rank: str = "rank", most: int = 1200) -> DataFrame:
    """Episodes as fenced snippets within four characters a token, the first always: (keys, episodes_text)."""
    text = strip(F.coalesce("text", F.lit("")))
    body = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n[…truncated]"))).otherwise(text)
    when = F.concat(F.lit(" — "), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"))
    session = F.when(F.coalesce("session_id", F.lit("")) != "", F.concat(F.lit("  _(session "), F.left("session_id", F.lit(12)), F.lit(")_")))
    block = F.concat(F.lit("### "), F.coalesce("source", F.lit("episode")), F.coalesce(when, F.lit("")), F.coalesce(session, F.lit("")), F.lit("\n```\n"), body, F.lit("\n```"))
    order = Window.partitionBy(*keys).orderBy(rank)
    e = episodes.filter(text != "").withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("_n", F.row_number().over(order)).filter((F.col("used") <= budget * 4) | (F.col("_n") == 1))
    return e.groupBy(*keys).agg(ordered_text(F.col("block"), [rank], "\n").alias("episodes_text"))


def recall_context(facts: Column, episodes: Column) -> Column:
    """Two headed sections; null if both are empty."""
    some = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    text = F.concat_ws("\n\n", some("## Known facts\n", facts), some("## Earlier episodes\n", episodes))
    return F.when(text != "", text)


def answer_block(answers: DataFrame, semantic: DataFrame, most_facts: int = 6, most_lines: int = 8, chars: int = 320) -> DataFrame:
    """(query_id, block): judged facts with confidence and pin marks, then further facts as triples."""
    line = F.concat(F.lit("- "), "subject", F.lit(" "), "predicate", F.lit(" "), "object", F.format_string(" (conf=%.2f)", "confidence"), F.when(F.col("pinned"), F.lit(" [pinned]")).otherwise(""))
    pick = Window.partitionBy("query_id").orderBy("rank")
    a = answers.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= most_facts)
    a = a.groupBy("query_id").agg(ordered_text(line, ["rank"], "\n").alias("judged"))
    s = semantic.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= most_lines)
    text = cut(F.concat_ws(" ", "subject", "predicate", "object"), chars)
    s = s.groupBy("query_id").agg(ordered_text(F.concat(F.lit("- "), text), ["rank"], "\n").alias("semantic"))
    both = a.join(s, "query_id", "full")
    some = lambda head, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c)))
    return both.select("query_id", F.concat_ws("\n\n", some("Judged facts:\n", "judged"), some("Related facts:\n", "semantic")).alias("block"))


# Results and tokens that a session's start recalls.
PRIMER = {"compact": (12, 2500), "resume": (8, 1500), "startup": (8, 1500)}


def session_primer(sessions: DataFrame) -> DataFrame:
    """(session_id, query, k, budget) from (session_id, cwd, kind); a cleared session recalls nothing."""
    name = F.element_at(F.split(F.rtrim(F.col("cwd"), F.lit("/")), "/"), -1)
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == kind, F.lit(v[i])) for kind, v in PRIMER.items()])
    return sessions.select("session_id", F.concat(F.lit("project "), name).alias("query"), pick(0).alias("k"), pick(1).alias("budget")).filter("k is not null")
