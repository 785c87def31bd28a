"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. It is rendered for every prefix of a
conversation; when each output begins with the one before, what a prefix adds is the span of its last turn. A template
for which that fails rewrites history: the first turn at which it did so is reported and spans from there on are null.

What a turn adds may depend on all turns before it, so a conversation is rendered whole, in one task. A template may declare
`context`, the number of turns before a turn that its span depends on at most: then long conversations are cut into segments
of SEGMENT_TURNS turns, each rendered after the context before it, so the work per row stays bounded. Either way the segments,
put together in order, are the template's output for all turns; a declared template found to rewrite history is an error.

- null text counts as empty, null role as "user"; turns are in order of turn (nulls first), ties by role and text;
- repeated rows are repeated turns; conversations with a null conv_id are one conversation; no rows give no rows;
- texts may hold any control string of the template, escape characters or line ends: reading back restores them;
- other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_TURNS = 256

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# Strings that steer a model and may not occur inside a turn as they are.
CONTROL = ["<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]

_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n(.*)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Double each backslash, then put one after the first character of every control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """<|turn|>role, a line end, the text, <|end|> and a line end, for each turn."""
    return "".join(f"<|turn|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}<|end|>\n" for role, text in turns)


#: A turn is written the same whatever is before it; a template that writes a mark at the very beginning would declare 1.
turn_template.context = 0


def turn_spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int] | None], int | None]:
    """The rendering of all turns, the span of each in it, and the number of the turn that rewrote history."""
    before, spans, rewritten = "", [], None
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        if rewritten is None and now.startswith(before):
            spans.append((len(before), len(now)))
        else:
            rewritten = k if rewritten is None else rewritten
            spans.append(None)
        before = now
    if rewritten is not None:
        # spans before the rewrite hold only if the last output still begins with what they were found in
        kept, whole = "", before
        for k, span in enumerate(spans):
            if span and whole.startswith(kept := template(turns[: k + 1])):
                continue
            spans[k] = None
    return before, spans, rewritten


def read_turn(piece: str) -> tuple[str, str, int, int]:
    """Role and text of a turn's span as turn_template writes it, and where its escaped text lies in the span."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError(f"not a turn: {piece[:80]!r}")
    return unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


def around_text(turns: list[Turn], role: str, template: Template, before: str = "") -> tuple[str, str]:
    """What the template writes before and after the text of a turn of `role` that follows `turns`, rendered as `before`.

    That is what its outputs for two texts without a common beginning or end have in common.
    """
    one, two = (template([*turns, (role, x)]) for x in ("a", "b"))
    if not (one.startswith(before) and two.startswith(before)):
        raise ValueError(f"the template's output before a turn of {role!r} depends on that turn's text")
    one, two = one[len(before) :], two[len(before) :]
    head = len(os.path.commonprefix([one, two]))
    tail = len(os.path.commonprefix([one[head:][::-1], two[head:][::-1]]))
    return one[:head], one[len(one) - tail :]


FORMATTED = "conv_id long, segment long, formatted string, n_turns long, roles array<string>, starts array<long>, ends array<long>, loss_starts array<long>, loss_ends array<long>, rewritten_at long"


def format_segments(conversations: DataFrame, template: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per segment of a conversation: its formatted text, each turn's span in it, and the spans under the loss mask.

    Spans are in code points of `formatted`; rewritten_at counts from the conversation's first turn. Turns of a template that
    rewrites history have null spans and are left out of the loss mask. A template without `context` has one segment.
    """
    context = getattr(template, "context", None)
    if context is not None and not 0 <= context <= SEGMENT_TURNS:
        raise ValueError(f"a template's context is at most {SEGMENT_TURNS} turns")

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place") if context is not None else rows.take(pa.array(_order(rows)))
        segment = rows["segment"][0].as_py()
        first = 0 if context is None else segment * SEGMENT_TURNS
        n_before = 0 if context is None else sum(x < first for x in rows["place"].to_pylist())
        if n_before == len(rows):
            # all context: the conversation ended with the segment before
            return _SCHEMA.empty_table()
        turns = list(zip(rows["role"].to_pylist(), rows["text"].to_pylist(), strict=True))
        whole, spans, rewritten = turn_spans(turns, template)
        if context is not None and rewritten is not None:
            raise ValueError(f"a template that declares a context rewrites history at turn {first + rewritten - n_before}")
        if context is not None and len(turns) > context + 1:
            # what follows the context must be the same without the first turn
            skipped = len(template(turns[1 : context + 1])) if context else 0
            if template(turns[1:])[skipped:] != whole[spans[context][1] :]:
                raise ValueError(f"the template's output depends on more turns than the {context} that it declares")
        heads: dict[str, tuple[str, str]] = {}
        loss = []
        for k in range(n_before, len(turns)):
            role = turns[k][0]
            if role not in loss_roles or not spans[k] or spans[k][0] == spans[k][1]:
                continue
            start, end = spans[k]
            if context == 0:
                head, tail = heads[role] = heads.get(role) or around_text([], role, template)
            else:
                head, tail = around_text(turns[:k], role, template, whole[:start])
            piece = whole[start:end]
            if len(head) + len(tail) > len(piece) or not (piece.startswith(head) and piece.endswith(tail)):
                raise ValueError(f"the template writes otherwise around this text than around others: {piece[:80]!r}")
            loss.append((start + len(head), end - len(tail)))
        base = spans[n_before - 1][1] if n_before else 0
        spans = spans[n_before:]
        return pa.table(
            {
                "conv_id": rows["conv_id"][:1],
                "segment": [segment],
                "formatted": [whole[base:]],
                "n_turns": [len(spans)],
                "roles": [[r for r, _ in turns[n_before:]]],
                "starts": [[s and s[0] - base for s in spans]],
                "ends": [[s and s[1] - base for s in spans]],
                "loss_starts": [[s - base for s, _ in loss]],
                "loss_ends": [[e - base for _, e in loss]],
                "rewritten_at": [rewritten],
            },
            schema=_SCHEMA,
        )

    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    if context is None:
        placed = clean.withColumn("segment", F.lit(0).cast("long"))
    else:
        placed = clean.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long") - 1)
        # a segment's last turns are the next one's context too
        segment = lambda place: F.floor(place / SEGMENT_TURNS).cast("long")
        placed = placed.withColumn("segment", F.explode(F.sequence(segment(F.col("place")), segment(F.col("place") + context))) if context else segment(F.col("place")))
    return placed.groupBy("conv_id", "segment").applyInArrow(one, FORMATTED)


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("roles", pa.list_(pa.string()))]
    + [(x, pa.list_(pa.int64())) for x in ("starts", "ends", "loss_starts", "loss_ends")]
    + [("rewritten_at", pa.int64())]
)


def _order(rows: pa.Table) -> list[int]:
    """Row numbers by turn (nulls first), role and text."""
    keys = list(zip(rows["turn"].to_pylist(), rows["role"].to_pylist(), rows["text"].to_pylist(), strict=True))
    return sorted(range(len(keys)), key=lambda i: (keys[i][0] is not None, keys[i][0] or 0, *keys[i][1:]))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame, read: Callable[[str], tuple] = read_turn, plain: Callable[[str], str] = unescape) -> DataFrame:
    """Per conversation, what reading the formatted text back gives: digests of its turns and of its text under the loss mask.

    read takes a turn's span and gives its role and text first; plain undoes the escapes of a text. They are those of
    turn_template unless others are given. Where history was rewritten turns can't be read back: the digests and loss_chars
    are null.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or state["conv_id"] != row["conv_id"]:
                    done += [state] if state else []
                    state = {"conv_id": row["conv_id"], "whole": True, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                whole = row["formatted"]
                state["whole"] &= row["rewritten_at"] is None
                state["n"] += row["n_turns"]
                state["chars"] += len(whole)
                if not state["whole"]:
                    continue
                for s, e in zip(row["starts"], row["ends"], strict=True):
                    role, text = read(whole[s:e])[:2]
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for s, e in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    text = plain(whole[s:e])
                    state["loss"].update(text.encode())
                    state["loss_chars"] += len(text)
            yield _digest_batch(done)
        if state:
            yield _digest_batch([state])

    sorted_segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return sorted_segments.mapInArrow(stream, DIGESTS)


def _digest_batch(states: list[dict]) -> pa.RecordBatch:
    of = lambda value: [value(s) if s["whole"] else None for s in states]
    return pa.RecordBatch.from_pydict(
        {
            "conv_id": pa.array([s["conv_id"] for s in states], pa.int64()),
            "n_turns": pa.array([s["n"] for s in states], pa.int64()),
            "turns_sha256": pa.array(of(lambda s: s["turns"].hexdigest()), pa.string()),
            "loss_chars": pa.array(of(lambda s: s["loss_chars"]), pa.int64()),
            "loss_sha256": pa.array(of(lambda s: s["loss"].hexdigest()), pa.string()),
            "formatted_chars": pa.array([s["chars"] for s in states], pa.int64()),
        }
    )


_SQL_ESCAPED = "replace({}, '\\', '\\\\')"
for _x in CONTROL:
    # no control string holds another, so one after the other gives what one pass gives
    _SQL_ESCAPED = f"replace({_SQL_ESCAPED}, '{_x}', '{_x[0]}\\{_x[1:]}')"

ORACLE = f"""
with c as (
  select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_SQL_ESCAPED.format("role")}) + length({_SQL_ESCAPED.format("text")}) + 17) as bigint) as formatted_chars
from c group by conv_id
"""
