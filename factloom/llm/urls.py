"""URL filter by a tree of path templates (DataFrame functions).

Rules on hosts and path beginnings decide first. The pages that they decide are labels for the rest. Below each host, a
tree of templates grows from fork to fork, on distinct paths: variable segments (numbers, dates, digests, mixed
identifiers, and rare words where there are many) become wildcards, and sibling branches whose labels do not differ
statistically become one branch, so that what lies below them is looked at together. A template is rejected when its
smoothed part of blocked labels is large; each level is smoothed towards the one above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Levels of the SQL below; the Spark tree goes down to the deepest path. For longer paths the SQL joins the last segments.
DEPTH = 4
#: Kinds of variable segments, the first that fits. A node with several segments of a kind has one wildcard for them. A
#: path holds no ``#``, so marks cannot clash with segments.
KINDS = (("#num", r"^[0-9]+$"), ("#date", r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), ("#hex", r"^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$"), ("#id", r"^[^0-9]*[0-9]+[^0-9]+[0-9].*$"))
LEAST_HEX = 8
#: Below a node with more than BRANCHES different segments left, those with less than SHARE of its pages become a wildcard.
BRANCHES, SHARE, ANY = 8, 0.05, "#any"
#: Siblings next to each other in the order of their blocked part are merged if the parts differ by Z deviations at most.
Z = 2.0
#: Weight of the level above in a template's blocked part, and of all pages in the host's; templates at CUT or more go.
SMOOTH, CUT = 4.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SUMS = ("n", "b", "a")


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def _by_rule(rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; rules are a short configured list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones stand outside and win
        fits = F.concat(F.lit("."), "host").endswith("." + host) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def kind(seg: str) -> Column:
    """The wildcard of a segment's kind, or null for a word."""
    out = F.lit(None).cast("string")
    for mark, pattern in reversed(KINDS):
        fits = F.col(seg).rlike(pattern)
        out = F.when(fits & (F.length(seg) >= LEAST_HEX) if mark == "#hex" else fits, mark).otherwise(out)
    return out


def _generalised(kids: DataFrame) -> DataFrame:
    """Add ``name`` to (host, template, seg, n, b, a): the segment, or the wildcard that stands for it below its node."""
    kids = kids.withColumn("kind", kind("seg"))
    sizes = kids.groupBy("host", "template", "kind").agg(F.count("*").alias("alike"))
    sizes = stored(sizes, "kinds")
    k = kids.alias("k").join(sizes.alias("s"), F.expr("k.host = s.host and k.template = s.template and k.kind <=> s.kind")).select("k.*", "s.alike")
    k = k.withColumn("name", F.when(F.col("kind").isNotNull() & (F.col("alike") > 1), F.col("kind")).otherwise(F.col("seg")))
    nodes = k.groupBy("host", "template").agg(F.count_distinct("name").alias("branches"), F.sum("n").alias("all_n"))
    k = k.join(stored(nodes, "nodes"), ["host", "template"])
    rare = (F.col("branches") > BRANCHES) & ~F.col("name").startswith("#") & (F.col("n") < SHARE * F.col("all_n"))
    return k.withColumn("name", F.when(rare, ANY).otherwise(F.col("name")))


def _merged(branches: DataFrame) -> DataFrame:
    """(host, template, name, to, purity) from (host, template, name, n, b, a, prior): siblings that do not differ share ``to``.

    After generalising, a node has at most BRANCHES or 1 / SHARE words and a wildcard of each kind, so its window is small.
    Branches without labels differ from nothing and stay apart.
    """
    order = Window.partitionBy("host", "template").orderBy("part", "name")
    one = branches.withColumn("labels", F.col("b") + F.col("a")).withColumn("part", F.try_divide("b", "labels"))
    one = one.withColumn("last_b", F.lag("b").over(order)).withColumn("last_n", F.lag("labels").over(order)).withColumn("last", F.lag("part").over(order))
    pooled = F.try_divide(F.col("b") + F.col("last_b"), F.col("labels") + F.col("last_n"))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "labels") + F.try_divide(F.lit(1.0), "last_n")))
    alike = F.coalesce(F.abs(F.col("part") - F.col("last")) <= Z * spread, F.lit(False))
    one = one.withColumn("chain", F.sum(F.when(alike, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = one.groupBy("host", "template", "chain").agg(F.array_join(F.sort_array(F.collect_list("name")), "#|").alias("label"), *[F.sum(c).alias(f"all_{c}") for c in ("b", "a")], F.first("prior").alias("prior"))
    purity = (F.col("all_b") + SMOOTH * F.col("prior")) / (F.col("all_b") + F.col("all_a") + SMOOTH)
    sums = stored(sums.select("host", "template", "chain", F.concat("template", F.lit("/"), "label").alias("to"), purity.alias("purity")), "merged")
    return one.select("host", "template", "name", "chain").join(sums, ["host", "template", "chain"]).drop("chain")


def _to_next_fork(tree: DataFrame) -> DataFrame:
    """Follow the segments that all paths at a node share, in one step, to where a path ends or they part.

    Such segments have no siblings to be generalised or merged with, so each only smooths the node's own part once more:
    after k of them the way from the prior to that part is the k-th power of one step's. What paths share is what the
    least and the greatest of them share.
    """
    tree = stored(tree, "paths")
    shared = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    node = tree.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.sum("b").alias("nb"), F.sum("a").alias("na"), F.first("prior").alias("p"))
    node = node.withColumn("k", F.when(shared == 0, F.size("lo")).otherwise(shared - 1).cast("int"))
    labels = F.col("nb") + F.col("na")
    part, left = F.try_divide("nb", labels), F.pow(SMOOTH / (labels + SMOOTH), F.col("k"))
    prior = F.when(labels > 0, part + (F.col("p") - part) * left).otherwise(F.col("p"))
    way = F.concat("template", F.array_join(F.transform(F.slice("lo", F.lit(1), F.col("k")), lambda s: F.concat(F.lit("/"), s)), ""))
    node = stored(node.filter("k > 0").select("host", "template", "k", way.alias("to"), prior.alias("further")), "shared-ways")
    on = tree.join(node, ["host", "template"], "left")
    k = F.coalesce("k", F.lit(0))
    return on.select("host", "segs", F.slice("rest", k + 1, F.size("rest")).alias("rest"), *_SUMS, F.coalesce("to", "template").alias("template"), F.coalesce("further", "prior").alias("prior"))


def judge_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    Null urls and urls without ``://`` have an empty host and path; they are a host like others. ``purity`` is the
    smoothed blocked part of the pages that end at the row's template. On a host without labels nothing is blocked beyond
    the rules. Repeated rows and null ids pass through, and equal urls have equal verdicts; an empty table gives an empty
    result; other columns are ignored. The driver's loop goes from fork to fork, so a long path that shares its segments
    with no other, or all of them, takes one round.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = _by_rule(rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = stored(rows.withColumn("segs", segs), "url-rows")
    count = lambda said: F.sum(F.when(F.col("said") == said, 1).otherwise(0))
    paths = stored(rows.groupBy("host", "segs").agg(F.count("*").alias("n"), count("block").alias("b"), count("allow").alias("a")), "paths")
    whole = paths.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    labelled = (whole["b"] or 0) + (whole["a"] or 0)
    overall = (whole["b"] / labelled) if labelled else 0.0
    hosts = paths.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("a").alias("ha"))
    part = (F.col("hb") + SMOOTH * overall) / (F.col("hb") + F.col("ha") + SMOOTH)
    hosts = stored(hosts.select("host", F.when(F.col("hb") + F.col("ha") > 0, part).otherwise(0.0).alias("prior")), "hosts")
    tree = paths.join(hosts, "host").select("host", "segs", F.col("segs").alias("rest"), *_SUMS, F.lit("").alias("template"), "prior")
    ended = []
    while True:
        tree = _to_next_fork(tree)
        ended.append(tree.filter(F.size("rest") == 0))
        at = stored(tree.filter(F.size("rest") > 0).withColumn("seg", F.get("rest", F.lit(0))), "forks")
        if not at.limit(1).count():
            break
        kids = stored(at.groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in _SUMS], F.first("prior").alias("prior")), "kids")
        named = stored(_generalised(kids), "names")
        branches = named.groupBy("host", "template", "name").agg(*[F.sum(c).alias(c) for c in _SUMS], F.first("prior").alias("prior"))
        to = _merged(stored(branches, "branches"))
        to = stored(named.select("host", "template", "seg", "name").join(to, ["host", "template", "name"]).drop("name"), "branches-to")
        at = at.drop("prior").join(to, ["host", "template", "seg"])
        tree = at.select("host", "segs", F.slice("rest", 2, F.size("rest")).alias("rest"), *_SUMS, F.col("to").alias("template"), F.col("purity").alias("prior"))
    tree = stored(reduce(DataFrame.unionByName, ended).select("host", "segs", *_SUMS, "template", "prior"), "tree")
    leaves = tree.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.first("prior").alias("prior"))
    pure = leaves.select("host", "template", ((F.col("b") + SMOOTH * F.col("prior")) / (F.col("b") + F.col("a") + SMOOTH)).alias("purity"))
    judged = stored(tree.select("host", "segs", "template").join(stored(pure, "purity"), ["host", "template"]), "judged")
    out = rows.join(judged, ["host", "segs"])
    method = F.when(F.col("purity") >= CUT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle(rules: tuple = RULES) -> str:
    fits = lambda h, p: f"('.' || host) like '%.{h}' and starts_with(path, '{p}')"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in longest) + " end"
    said = "case " + " ".join(f"when {fits(h, p)} then '{s}'" for s, h, p in longest) + " end"
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    kinds = "case " + " ".join(f"when regexp_matches(seg, '{p}'){f' and length(seg) >= {LEAST_HEX}' if m == '#hex' else ''} then '{m}'" for m, p in KINDS) + " end"
    sql = f"""
with u as materialized (select page_id, translate(regexp_extract(coalesce(url, ''), '{parts}', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '{parts}', 2) as path from pages),
v as (select *, {rule} as rule, {said} as said, list_filter(string_split(path, '/'), lambda s: s <> '') as s0 from u),
r as materialized (select *, case when len(s0) > {DEPTH} then list_concat(s0[1:{DEPTH - 1}], [array_to_string(s0[{DEPTH}:], '/')]) else s0 end as segs from v),
d as (select host, segs, count(*) as n, count(*) filter (said = 'block') as b, count(*) filter (said = 'allow') as a from r group by host, segs),
g as (select coalesce(sum(b) / nullif(sum(b) + sum(a), 0), 0)::double as overall from d),
h as (select host, case when sum(b) + sum(a) > 0 then (sum(b) + {SMOOTH} * any_value(overall)) / (sum(b) + sum(a) + {SMOOTH}) else 0 end::double as prior from d, g group by host),
t0 as materialized (select d.*, '' as template, prior from d join h using (host))"""
    for d in range(DEPTH):
        sql += f""",
k{d} as (select host, template, segs[{d + 1}] as seg, sum(n)::bigint as n, sum(b)::bigint as b, sum(a)::bigint as a, any_value(prior) as prior from t{d} where len(segs) > {d} group by all),
w{d} as (select *, case when kind is not null and count(*) over (partition by host, template, kind) > 1 then kind else seg end as w from (select *, {kinds} as kind from k{d})),
c{d} as (select host, template, count(distinct w) as branches, sum(n)::bigint as all_n from w{d} group by all),
m{d} as materialized (select w.*, case when branches > {BRANCHES} and not starts_with(w, '#') and n < {SHARE}::double * all_n then '{ANY}' else w end as name from w{d} w join c{d} using (host, template)),
n{d} as (select host, template, name, sum(b)::bigint as b, sum(a)::bigint as a, any_value(prior) as prior, sum(b) / nullif(sum(b) + sum(a), 0) as part from m{d} group by host, template, name),
l{d} as (select *, lag(b) over o as lb, lag(b + a) over o as ln, lag(part) over o as lp from n{d} window o as (partition by host, template order by part nulls first, name)),
q{d} as (select *, (b + lb) / nullif(b + a + ln, 0) as pooled from l{d}),
x{d} as (select *, sum(case when coalesce(abs(part - lp) <= {Z}::double * sqrt(pooled * (1 - pooled) * (1.0::double / nullif(b + a, 0) + 1.0::double / nullif(ln, 0))), false) then 0 else 1 end) over (partition by host, template order by part nulls first, name rows unbounded preceding) as chain from q{d}),
y{d} as (select host, template, chain, template || '/' || string_agg(name, '#|' order by name) as nxt, (sum(b) + {SMOOTH}::double * any_value(prior)) / (sum(b) + sum(a) + {SMOOTH}::double) as purity from x{d} group by host, template, chain),
z{d} as materialized (select m.host, m.template, m.seg, nxt, purity from m{d} m join x{d} x on m.host = x.host and m.template = x.template and m.name = x.name join y{d} y on y.host = x.host and y.template = x.template and y.chain = x.chain),
t{d + 1} as materialized (select t.host, t.segs, t.n, t.b, t.a, coalesce(z.nxt, t.template) as template, coalesce(z.purity, t.prior) as prior from t{d} t left join z{d} z on t.host = z.host and t.template = z.template and t.segs[{d + 1}] = z.seg)"""
    return sql + f""",
p as (select host, template, (sum(b) + {SMOOTH}::double * any_value(prior)) / (sum(b) + sum(a) + {SMOOTH}::double) as purity from t{DEPTH} group by host, template)
select page_id, r.host, path, rule, coalesce(said, case when purity >= {CUT} then 'block' else 'allow' end) as verdict, t.template, round(purity, 6)::double as purity
from r join t{DEPTH} t on r.host = t.host and r.segs = t.segs join p on p.host = t.host and p.template = t.template
"""
