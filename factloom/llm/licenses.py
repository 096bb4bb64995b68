"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags in one pass over a text's words; the
expressions behind the tags are parsed by the shunting-yard method and evaluated against a policy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from factloom.llm.common import id_as_text, id_from_text

# Phrases of the contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that this operator adds.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: The tag, as words.
TAG = "spdx license identifier"
#: Families of identifiers, by their beginnings; the first that fits counts.
FAMILIES = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"), ("mpl", "mpl"), ("epl", "epl"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nc", "cc-by-nc"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("unlicense", "unlicense"))
#: The policy: families whose texts may be used.
ALLOWED = frozenset({"apache", "mit", "bsd", "isc", "cc-by", "cc0", "unlicense"})

#: Everything of ASCII but digits and small letters separates words; the text is lower-cased before.
_SEPARATE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_TAG_LINE = re.compile(r"spdx[^\n0-9a-z\x80-\U0010ffff]+license[^\n0-9a-z\x80-\U0010ffff]+identifier[ \t]*:?[ \t]*([^\n]*)")
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in table.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    a.make_automaton()
    return a


def family(identifier: str) -> str:
    return next((label for start, label in FAMILIES if identifier.startswith(start)), identifier.rstrip("+"))


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard over identifiers, parentheses and the three operators; None if it is no expression."""
    out, ops, want = [], [], True
    for t in tokens:
        if t == "(":
            if not want:
                return None
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if want or not ops:
                return None
            ops.pop()
        elif t in _RANK:
            if want:
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
            want = True
        else:
            if not want:
                return None
            out.append(t)
            want = False
    if want or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> tuple[bool, set[str]]:
    """Whether the policy allows the expression, and the families it names. An exception never changes its licence."""
    names: list[str] = []
    stack: list[tuple[bool, int]] = []  # a verdict, and how many of the last names are its operand's
    for t in postfix:
        if t not in _RANK:
            names.append(family(t))
            stack.append((names[-1] in ALLOWED, 1))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "with":
            del names[len(names) - right :]
            stack.append((a, left))
        else:
            stack.append((a or b if t == "or" else a and b, left + right))
    return stack[0][0], set(names)


def complete(tokens: list[str]) -> int:
    """How many tokens the longest beginning has that is an expression; one pass, as far as tokens can be continued."""
    depth, want, found = 0, True, 0
    for n, t in enumerate(tokens, 1):
        opens = t == "("
        if want != (opens or (t != ")" and t not in _RANK)):
            break
        depth += opens - (t == ")")
        if depth < 0:
            break
        want = opens or t in _RANK
        if not want and depth == 0:
            found = n
    return found


def expression(line: str) -> tuple[list[str] | None, str]:
    """Postfix of the longest beginning of a line that is an expression, and its text."""
    tokens, at = [], 0
    while m := _TOKEN.match(line, at):
        tokens.append(m[1])
        at = m.end()
    tokens = tokens[: complete(tokens)]
    return to_postfix(tokens), " ".join(tokens)


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, allowed)."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z
    words = low.translate(_SEPARATE).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, own, starts, tagged = set(), set(), [], False
    for end, (kind, label, size) in automaton().iter(joined):
        if kind == "tag":
            tagged = True
        else:
            (base if kind == "base" else own).add(label)
            if kind == "base":
                starts.append(end - size + 1)
    expressions, verdicts = [], []
    if tagged:
        for m in _TAG_LINE.finditer(low.decode("utf-8", "surrogatepass")):
            postfix, said = expression(m[1])
            if postfix:
                allowed, named = evaluate(postfix)
                own |= named
                verdicts.append(allowed)
                expressions.append(said)
    first, last = (joined.count(" ", 0, at) for at in (min(starts), max(starts))) if starts else (None, None)
    labels = base | own
    allowed = all(verdicts) if verdicts else (labels <= ALLOWED if labels else None)
    evidence = len(starts) + len(own) + 2 * len(expressions)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), evidence / (evidence + 1.0), expressions, allowed


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, allowed.

    ``allowed`` is the policy's verdict on all expressions, else on all labels, else null. A broken expression after a
    tag counts as far as its beginning is one, or not at all. Null and empty texts have no words, places or labels.
    Repeated rows and null ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    schema = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            made = pd.DataFrame([(None, *scan(t)) for t in pdf["text"]], columns=names)
            made["doc_id"] = pdf["doc_id"].to_numpy()
            yield made.astype({"first_word": "Int64", "last_word": "Int64", "allowed": "boolean"})

    return id_from_text(docs.select(id_as_text(), "text").mapInPandas(run, schema))


def oracle() -> str:
    """DuckDB SQL for texts without an identifier tag, whose expressions SQL cannot parse; a row with one fails the comparison.

    Words stand between two spaces each, so places of a phrase do not overlap and splitting at it counts them.
    """
    spaced = lambda phrase: f"' {phrase.replace(' ', '  ')} '"
    labels = lambda table: ", ".join(f"case when contains(j, {spaced(p)}) then '{label}' end" for p, label in table.items())
    clean = "list_sort(list_distinct(list_filter({0}, lambda x: x is not null)))"
    before = "case when {0} = '' then 0 else 1 + (length({0}) - length(replace({0}, '  ', ''))) // 2 end"
    split = ", ".join(f"string_split(j, {spaced(p)}) as s{k}" for k, p in enumerate(BASE))
    places = " + ".join(f"len(s{k}) - 1" for k in range(len(BASE)))
    firsts = ", ".join(f"case when len(s{k}) > 1 then {before.format(f's{k}[1]')} end" for k in range(len(BASE)))
    lasts = ", ".join(f"case when len(s{k}) > 1 then {before.format(f'left(j, length(j) - length(s{k}[-1]) - {len(p) + p.count(" ") + 2})')} end" for k, p in enumerate(BASE))
    allowed = ", ".join(f"'{a}'" for a in sorted(ALLOWED))
    return rf"""
with t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
u as (select doc_id, len(w) as n_words, ' ' || array_to_string(w, '  ') || ' ' as j from t),
p as (select doc_id, n_words, j, {split}, {clean.format('[' + labels(BASE) + ']')} as base, {clean.format('[' + labels(NOTICES) + ']')} as own, contains(j, {spaced(TAG)}) as tagged from u),
q as (select *, {places} as places, list_min([{firsts}]) as first_word, list_max([{lasts}]) as last_word from p),
e as (select *, list_sort(list_distinct(base || own)) as every, places + len(own) as evidence from q)
select doc_id, n_words, places as n_base, first_word, last_word, array_to_string(base, ',') as base_labels, array_to_string(every, ',') as labels,
  evidence / (evidence + 1.0::double) as score, case when not tagged then []::varchar[] end as expressions, case when len(every) > 0 then len(list_filter(every, lambda x: x not in ({allowed}))) = 0 end as allowed from e
"""
