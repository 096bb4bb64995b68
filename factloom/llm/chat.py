"""Chat formatting.

A finite-state machine over roles validates the order of turns. A declarative template turns each of them into text
segments with loss flags. Control strings inside texts are escaped, reversibly, so a text can never open or close a turn.
Both directions stream over rows that Spark has ordered; a conversation of any length needs the memory of one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from factloom.llm.common import id_as_text, id_from_text


@dataclass(frozen=True)
class Template:
    #: Role: text before, text after, whether its text counts for the loss. ``*`` stands for all others.
    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
            "user": ("<s>[INST] ", " [/INST]", False),
            "assistant": (" ", " </s>\n", True),
            "*": ("[TURN] {role}\n", " [/TURN]\n", False),
        }
    )
    #: Strings that must not occur in a text.
    control: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/TURN]")
    #: State: the states that a role leads to. Conversations may end where ``accepting`` says.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
            "broken": {},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


DEFAULT = Template()
SEGMENTS = "conv_id string, turn_no long, part int, role string, segment string, loss boolean, state string"


def escape(text: str, template: Template = DEFAULT) -> str:
    """Backslashes are doubled, then each control string is parted after its first character by a backslash and ``!``."""
    found = re.compile("|".join(re.escape(c) for c in sorted(template.control, key=len, reverse=True)))
    return found.sub(lambda m: f"{m[0][0]}\\!{m[0][1:]}", text.replace("\\", "\\\\"))


_ESCAPED = re.compile(r"\\(\\|!|n)")
_MEANS = {"\\": "\\", "!": "", "n": "\n"}


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANS[m[1]], text)


def _role(role: str, template: Template) -> str:
    """A role's name in the one line that it has."""
    return escape(role, template).replace("\n", "\\n")


def format_chats(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn_no, part, role, segment, loss, state): three segments a turn, in order within each partition.

    Parts: 0 opens the turn, 1 is its text, 2 closes it. ``state`` is the machine's state after the turn; ``broken`` from
    the first turn that is out of order. Null texts and roles are empty. Turns of one number are ordered by role and
    text; null numbers come first; repeated rows are turns of their own. Null conv_ids form one conversation. Turns of
    one conversation meet in one task, as its order asks, but only one row is held at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, number = (), "start", 0  # no conversation before the first row
        for pdf in batches:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                if conv != last:
                    last, state, number = conv, "start", 0
                role, text = role or "", text or ""
                state = template.machine[state].get(role, "broken")
                before, after, loss = template.turns.get(role) or template.turns["*"]
                out.append((conv, number, 0, role, before.replace("{role}", _role(role, template)), False, state))
                out.append((conv, number, 1, role, escape(text, template), loss, state))
                out.append((conv, number, 2, role, after, False, state))
                number += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    rows = conversations.select(id_as_text("conv_id"), "turn", "role", "text")
    return id_from_text(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, SEGMENTS), "conv_id")


def _readers(template: Template) -> list[tuple[str, re.Pattern]]:
    """A pattern for each kind of turn over its text; no text holds a control string, so the first end is the end."""
    out = []
    for role, (before, after, _) in template.turns.items():
        opened = re.escape(before).replace(re.escape("{role}"), "(?P<role>.*?)")
        out.append((role, re.compile(f"{opened}(?P<text>.*){re.escape(after)}", re.DOTALL)))
    return out


DIGESTS = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of each conversation, read from the formatted text of :func:`format_chats` alone.

    Roles and texts are parsed from the text of whole turns; the loss mask is that of the segments, whose numbers give
    their order. Segments of another template are an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = _readers(template)
        last, now = (), None

        def done() -> tuple:
            return (last, now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["state"] in template.accepting)

        for pdf in batches:
            out = []
            for conv, part, segment, loss, state in zip(pdf["conv_id"], pdf["part"], pdf["segment"], pdf["loss"], pdf["state"], strict=True):
                if conv != last:
                    if now:
                        out.append(done())
                    last, now = conv, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "text": "", "state": "start"}
                now["chars"] += len(segment)
                now["text"] += segment
                now["state"] = state
                if loss:
                    plain = unescape(segment)
                    now["loss"].update(plain.encode("utf-8", "surrogatepass"))
                    now["loss_chars"] += len(plain)
                if part == 2:
                    role, m = next(((r, m) for r, p in readers if (m := p.fullmatch(now["text"]))), (None, None))
                    if m is None:
                        raise ValueError(f"a turn of conversation {conv} is not of this template")
                    said = unescape(m["role"]) if role == "*" else role
                    now["turns"].update(f"{said}\n{unescape(m['text'])}\n".encode("utf-8", "surrogatepass"))
                    now["n"], now["text"] = now["n"] + 1, ""
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")])
        if now:
            yield pd.DataFrame([done()], columns=[c.split()[0] for c in DIGESTS.split(", ")])

    rows = segments.select(id_as_text("conv_id"), "turn_no", "part", "segment", "loss", "state")
    return id_from_text(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part").mapInPandas(run, DIGESTS), "conv_id")


def oracle(template: Template = DEFAULT) -> str:
    """The same digests from the turns themselves: what a reversible format must give back, and the lengths it must have."""
    control = "|".join(re.escape(c) for c in sorted(template.control, key=len, reverse=True))
    escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, chr(92), '')) + 2 * len(regexp_extract_all({c}, '{control}'))"
    size, loss, accept = "", "", "', '".join(template.accepting)
    for role, (before, after, counts) in template.turns.items():
        if role != "*":
            size += f" when role = '{role}' then {len(before) + len(after)}"
            loss += f" when role = '{role}' then {str(counts).lower()}"
    before, after, counts = template.turns["*"]
    named = before.count("{role}")
    size += f" else {len(before) - 6 * named + len(after)} + {named} * ({escaped('role')} + length(role) - length(replace(role, chr(10), '')))"
    moves = " ".join(f"when s.state = '{a}' and m.role = '{r}' then '{b}'" for a, to in template.machine.items() for r, b in to.items())
    return f"""
with recursive t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, case{loss} else {str(counts).lower()} end as counts, case{size} end + {escaped('text')} as size from t),
s as (select conv_id, 0::bigint as k, 'start' as state from (select distinct conv_id from m)
  union all select m.conv_id, m.k, case {moves} else 'broken' end from s join m on m.conv_id is not distinct from s.conv_id and m.k = s.k + 1),
e as (select conv_id, arg_max(state, k) in ('{accept}') as valid from s group by conv_id)
select m.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (counts), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (counts), '')) as loss_sha256,
  sum(size)::bigint as formatted_chars, any_value(valid) as valid from m join e on m.conv_id is not distinct from e.conv_id group by m.conv_id
"""
