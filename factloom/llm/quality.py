"""Quality rules: plain counts with fixed limits, then robust multivariate outliers.

Statistics of every text are transformed to a vector of near-normal parts. For each language and source, the
minimum-covariance-determinant estimate of location and scatter comes from blocks of a bounded number of rows
(concentration steps in numpy), is averaged over the group's blocks, and is re-weighted over all of the group's rows.
Rows whose Mahalanobis distance is too large are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import id_as_text, id_from_text, stored
from factloom.llm.wordhash import runs, word_hashes

SYMBOLS = "#*$%&|<>"
_LETTERS = np.array([c for c in range(128) if chr(c).isalpha()])
PARTS = ("x0", "x1", "x2", "x3", "x4")
P = len(PARTS)
#: Rows, about, of a block that starting values come from; rows as which the estimate over all groups counts in each.
BLOCK, PRIOR = 1_000, 20.0
#: Concentration steps over whole groups; classes of squared distances for each factor of e; their median for normal vectors.
STEPS, CLASSES, MEDIAN = 2, 100, 4.351
#: Rows of a table of groups, some 200 bytes each, up to which it is broadcast.
FEW = 20_000
#: Squared distances of a normal vector of P parts lie below these with 0.975 and 0.999999.
WEIGHT_CUT, REJECT_CUT = 12.83, 35.89
#: Scatter of a normal sample that is cut off at WEIGHT_CUT, as a part of the whole scatter.
SHRUNK = 0.9246
#: Added to each variance: parts are logarithms, and a spread of 0.14 in them says nothing. It also keeps constant parts
#: from making the scatter singular.
RIDGE = 0.02
STATS = "doc_id string, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{p} double" for p in PARTS)


def text_statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, x0, ...) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = word_hashes(raw)
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 5:
        windows = runs(words, 5)
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        if len(starts):
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + 5, -1)
            repeat = int((np.cumsum(cover)[:n] > 0).sum())
    raw_bytes = np.frombuffer(raw, np.uint8)
    seen_bytes = np.bincount(raw_bytes, minlength=256)
    p = seen_bytes[seen_bytes > 0] / max(1, len(raw))
    entropy = float(-(p * np.log(p)).sum())
    # Distinct words in runs of 50, which does not depend on the length as a whole does.
    whole = words[: n - n % 50].reshape(-1, 50)
    distinct = (np.diff(np.sort(whole, axis=1), axis=1) != 0).sum() + len(whole) + len(np.unique(words[n - n % 50 :]))
    other = word_chars - int(seen_bytes[_LETTERS].sum()) - sum(1 for c in text if c >= "\x80")
    # Short texts are drawn towards ordinary values, so that chance alone makes no outlier of them.
    x = (
        np.log((other + 10) / (word_chars + 200)),
        np.log((word_chars + 100) / (n + 20)),
        np.log((distinct + 36) / (n + 40)),
        (entropy * len(raw) + 3.0 * 300) / (len(raw) + 300),
        np.log(0.005 + symbols / (len(text) + 200)),
    )
    return (n, word_chars, symbols, dup, repeat, *map(float, x))


def statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *PARTS]
        for pdf in batches:
            made = pd.DataFrame([text_statistics(t) for t in pdf["text"]], columns=names)
            yield pd.concat([pdf[["doc_id", "lang", "source"]].reset_index(drop=True), made], axis=1)

    return id_from_text(docs.select(id_as_text(), "lang", "source", "text").mapInPandas(run, STATS))


def mcd(x: np.ndarray, starts: int = 12, steps: int = 12, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of the half of the rows with the least determinant, by concentration steps."""
    n, p = x.shape
    h = (n + p + 1) // 2
    ridge = RIDGE * np.eye(p)
    rng = np.random.default_rng(seed)
    # One start is the rows nearest the medians in units of the median deviation; the others are random.
    mid = np.median(x, axis=0)
    mad = np.median(np.abs(x - mid), axis=0) + 1e-6
    firsts = [np.argsort((((x - mid) / mad) ** 2).sum(axis=1), kind="stable")[:h]]
    firsts += [rng.choice(n, min(n, p + 1), replace=False) for _ in range(starts - 1)]
    best = None
    for rows in firsts:
        last = np.inf
        for _ in range(steps):
            m, c = x[rows].mean(axis=0), np.cov(x[rows].T, bias=True).reshape(p, p) + ridge
            d = x - m
            rows = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d), kind="stable")[:h]
            det = np.linalg.slogdet(np.cov(x[rows].T, bias=True).reshape(p, p) + ridge)[1]
            if det >= last - 1e-9:
                break
            last = det
        if best is None or last < best[0]:
            best = (last, rows)
    m, c = x[best[1]].mean(axis=0), np.cov(x[best[1]].T, bias=True).reshape(p, p) + ridge
    d = x - m
    # Consistency at the normal: the median squared distance is that of chi-squared with P degrees.
    scale = np.median(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / 4.351
    return m, c * max(scale, 1e-6)


_MOMENTS = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i in range(P) for j in range(i + 1)]
_WHITE = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def _whitening(moments: DataFrame) -> DataFrame:
    """(g_lang, g_source, m*, l*): rows of the inverse Cholesky factor, so that distances are plain arithmetic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf[_MOMENTS].to_numpy(dtype=float):
                c = np.zeros((P, P))
                c[np.tril_indices(P)] = r[P:]
                c = c + np.tril(c, -1).T
                c += RIDGE * np.eye(P)
                out.append([*r[:P], *np.linalg.inv(np.linalg.cholesky(c))[np.tril_indices(P)]])
            made = pd.DataFrame(out, columns=_WHITE)
            yield pd.concat([pdf[["g_lang", "g_source"]].reset_index(drop=True), made], axis=1)

    return moments.mapInPandas(run, "g_lang string, g_source string, " + ", ".join(f"{c} double" for c in _WHITE))


def _distance() -> Column:
    parts = []
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"l{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        parts.append(z * z)
    return sum(parts[1:], parts[0])


def _with_group(rows: DataFrame, per_group: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the group. ``per_group`` is a written table; it is broadcast if it has FEW rows at most, so that rows stay
    where they are and sums are partial before they move. A larger one is merged, and a hot group split by the skew handling."""
    few = per_group.count() <= FEW
    return rows.join(F.broadcast(per_group) if few else per_group.hint("merge"), ["g_lang", "g_source"], how)


def _mean_and_scatter(rows: DataFrame, shrunk: float = 1.0) -> DataFrame:
    """(g_lang, g_source, n, moments) about the current centre, from partial sums; scatter is divided by ``shrunk``."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    sums = rows.groupBy("g_lang", "g_source").agg(
        F.count("*").alias("n"),
        *[F.first(f"m{i}").alias(f"o{i}") for i in range(P)],
        *[F.avg(d[i]).alias(f"a{i}") for i in range(P)],
        *[F.avg(d[i] * d[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)],
    )
    return sums.select(
        "g_lang",
        "g_source",
        "n",
        *[(F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(P)],
        *[((F.col(f"s{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) / shrunk).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)],
    )


def _drawn_together(groups: DataFrame, moments: DataFrame) -> DataFrame:
    """Whitening of each group's moments ``(n, m*, c*)``, mixed with the moments over all groups as if those were PRIOR rows.

    The mixture's scatter has what lies between its parts. A group without rows takes the whole's. One row of moments comes
    to the driver.
    """
    moments = stored(moments, "moments")
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    whole = moments.agg(
        *[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(P)],
        *[(F.sum(F.col("n") * (F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}"))) / F.sum("n")).alias(f"c{i}{j}") for i, j in pairs],
    ).first()
    pm = [float(whole[f"m{i}"] or 0.0) for i in range(P)]
    pc = {(i, j): float(whole[f"c{i}{j}"] or 0.0) - pm[i] * pm[j] for i, j in pairs}
    g = _with_group(groups.select("g_lang", "g_source"), moments, "left")
    n = F.coalesce("n", F.lit(0))
    own, rest = n / (n + PRIOR), PRIOR / (n + PRIOR)
    m = [F.coalesce(f"m{i}", F.lit(pm[i])) for i in range(P)]
    mixed = [(own * m[i] + rest * pm[i]).alias(f"m{i}") for i in range(P)]
    spread = [(own * F.coalesce(f"c{i}{j}", F.lit(0.0)) + rest * pc[i, j] + own * rest * (m[i] - pm[i]) * (m[j] - pm[j])).alias(f"c{i}{j}") for i, j in pairs]
    return stored(_whitening(g.select("g_lang", "g_source", *mixed, *spread)), "estimates")


def _scales(rows: DataFrame) -> DataFrame:
    """(g_lang, g_source, half): the squared distance ``d2`` below which half of a group's rows lie, drawn towards that of all
    rows in the same way. Rows are counted by classes of distances, of which there is a bounded number."""
    cls = F.floor(F.log(F.col("d2") + 1e-12) * CLASSES).cast("int")
    counts = stored(rows.groupBy("g_lang", "g_source", cls.alias("cls")).agg(F.count("*").alias("c")), "distance-classes")

    def half(of: DataFrame, keys: list[str]) -> DataFrame:
        key = Window.partitionBy(*keys)
        upto = F.sum("c").over(key.orderBy("cls").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        r = of.withColumn("upto", upto).withColumn("n", F.sum("c").over(key)).filter(F.col("upto") * 2 >= F.col("n"))
        return r.groupBy(*keys).agg(F.exp((F.min("cls") + 1) / CLASSES).alias("half"), F.max("n").alias("n"))

    # The classes of all rows are a few thousand counts in one window.
    whole = half(counts.groupBy("cls").agg(F.sum("c").alias("c")).withColumn("k", F.lit(0)), ["k"]).first()
    by = half(counts, ["g_lang", "g_source"])
    drawn = (F.col("n") * F.col("half") + PRIOR * float(whole["half"] if whole else 1.0)) / (F.col("n") + PRIOR)
    return stored(by.select("g_lang", "g_source", drawn.alias("half")), "scales")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Null and empty texts have zero counts and fail the base rules. Null languages and sources are groups like others.
    Rows that fail the base rules take no part in the estimates. Repeated rows count as rows, and rows with equal
    statistics have equal verdicts. Long texts are read whole. An empty table gives an empty result; other columns are
    ignored.
    """
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stored(statistics(docs).withColumn("base_failed", failed), "statistics")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    good = rows.filter("not base_failed").select("doc_id", *PARTS, text("lang").alias("g_lang"), text("source").alias("g_source"))
    sizes = stored(good.groupBy("g_lang", "g_source").agg(F.count("*").alias("size")), "group-sizes")
    # Blocks of about BLOCK rows, dealt by the hash of the row and its place, so that repeated rows are spread, too. What is
    # dealt is written before it is used, so a lost task changes nothing.
    block = F.pmod(F.xxhash64("doc_id", *PARTS, F.monotonically_increasing_id()), F.greatest(F.lit(1), F.col("size").cast("long") / BLOCK).cast("long"))
    own = stored(_with_group(good, sizes).withColumn("block", block), "vectors")
    names = ["g_lang", "g_source", "n", *_MOMENTS]

    def start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, c = mcd(pdf[list(PARTS)].sort_values(list(PARTS)).to_numpy(dtype=float))
        return pd.DataFrame([[key[0], key[1], len(pdf), *m, *c[np.tril_indices(P)]]], columns=names)

    blocks = own.groupBy("g_lang", "g_source", "block").applyInPandas(start, "g_lang string, g_source string, n long, " + ", ".join(f"{c} double" for c in _MOMENTS))
    mean = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in _MOMENTS]
    now = _drawn_together(sizes, blocks.groupBy("g_lang", "g_source").agg(F.sum("n").alias("n"), *mean))
    own = own.select("doc_id", *PARTS, "g_lang", "g_source")
    for step in range(STEPS + 1):
        far = _with_group(own, now).withColumn("d2", _distance())
        near = _with_group(far, _scales(far))
        last = step == STEPS  # the nearest half, and at last all rows that are no outliers at the scale of the half
        limit = F.col("half") * (WEIGHT_CUT / MEDIAN if last else 1.0)
        now = _drawn_together(sizes, _mean_and_scatter(near.filter(F.col("d2") <= limit), SHRUNK if last else 1.0))
    by_row = rows.select(*counts, "base_failed", *PARTS, text("lang").alias("g_lang"), text("source").alias("g_source"))
    out = _with_group(by_row, now, "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_distance())))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") * F.col("distance") <= REJECT_CUT, F.lit(True))
    return out.select(*counts, "base_failed", "distance", kept.alias("kept"))
