"""Byte-level BPE over a corpus: each distinct pre-token is encoded once.

Texts are cut into pre-tokens by the vocabulary's pattern in the JVM. Dictionary blocks keep their positions; the
distinct words of all blocks are shuffled by word, each is merged once, and its ids join the blocks back, which put the
ids of every document together by position. Decoding gathers each id's bytes from the token-byte table, whose size is
that of the vocabulary.

- null text counts as empty and has no ids; rows that repeat a doc_id are encoded each on its own; doc_id may be null;
- special tokens are ordinary text; an empty table gives an empty result; other columns are ignored;
- decoding null ids gives null; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shareflow.llm import blocks
from shareflow.llm.common import text_or_empty

Ranks = dict[bytes, int]
#: Makes, once a task, the function from a list array of ids to columns.
Finish = Callable[[], Callable[[pa.ListArray], dict[str, pa.Array]]]


def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pretokens(pattern: str):
    """Every match of the pattern, with Unicode character classes."""
    return F.regexp_extract_all(text_or_empty(), F.lit(f"(?U){pattern}"), F.lit(0))


@lru_cache(maxsize=1)
def _classes() -> Callable[[str], str]:
    """Stands a known character of the same class in for any other, by what the library's own engine takes it for."""
    single = {bytes([k]): k for k in range(256)}
    kinds = [(tiktoken.Encoding(f"class {c}", pat_str=c, mergeable_ranks=single, special_tokens={}), known) for c, known in ((r"\p{L}", "é"), (r"\p{N}", "²"), (r"\s", "\u3000"))]

    @lru_cache(maxsize=100_000)
    def kind(c: str) -> str:
        return c if c < "\x80" else next((known for engine, known in kinds if engine.encode_ordinary(c)), "§")

    return kind


def cut_exactly(pattern: str, text: str) -> list[str]:
    """The pre-tokens of a text for a pattern of the classes L, N and white space, whatever Unicode version its letters are of."""
    kind = _classes()
    return [text[m.start() : m.end()] for m in regex.finditer(pattern, "".join(map(kind, text)))]


def newer_letters(pattern: str) -> blocks.Odd:
    """Texts with characters that Java's Unicode tables don't know are cut by the library's."""
    return F.when(F.col("text").rlike(r"\p{Cn}"), F.col("text")), partial(cut_exactly, pattern)


def encode(docs: DataFrame, ranks: Ranks, pattern: str, finish: Finish | None = None, columns: str = "ids array<int>") -> DataFrame:
    """doc_id and ids (array<int>), a row per row of docs.

    finish turns the ids of some documents, in the task that has put them together, into other columns (`columns`, in
    SQL): so a query that needs only sums of the ids doesn't send them through a second Python worker.
    """
    finish = finish or (lambda: lambda ids: {"ids": ids})
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def words_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})._encode_single_piece
        known: dict[str, list[int]] = {}
        for batch in batches:
            answers = []
            for payload in batch.column("words").to_pylist():
                ids = []
                for word in blocks.unpack_strings(payload).to_pylist():
                    if (got := known.get(word)) is None:
                        got = known[word] = merge(word)
                    ids.append(got)
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((x for one in ids for x in one), np.int64, int(lengths.sum()))
                answers.append((blocks.pack_ints(lengths), blocks.pack_ints(flat)))
            out = {c: batch.column(c) for c in ("block", "bucket", "mark")}
            out |= {"lengths": pa.array([a for a, _ in answers], pa.binary()), "flat": pa.array([b for _, b in answers], pa.binary())}
            yield pa.RecordBatch.from_pydict(out)
        blocks.release()

    def reassemble(rows: pa.Table, answers: pa.Table) -> pa.Table:
        parts, done = [], finish()
        for row in rows.to_pylist():
            got = blocks.answers_in_order(answers, row["mark"])
            lengths = np.concatenate([blocks.unpack_ints(a["lengths"]) for a in got] or [np.empty(0, int)]).astype(np.int64)
            flat = np.concatenate([blocks.unpack_ints(a["flat"]) for a in got] or [np.empty(0, int)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            place, size = blocks.positions(row)
            ends = np.cumsum(lengths[place])
            ends = np.concatenate([[0], ends])[np.cumsum(size)] if len(place) else np.zeros(len(size), np.int64)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, words.take(pa.array(place)).flatten() if len(place) else pa.array([], pa.int32()))
            parts.append(pa.table({"doc_id": pa.array(row["ids"], rows.schema.field("ids").type.value_type), **done(ids)}))
        blocks.release()
        return pa.concat_tables(parts)

    made = blocks.build(docs, pretokens(pattern), odd=newer_letters(pattern))
    asked = made.words.drop("counts").repartition(made.buckets, "bucket")
    answers = asked.mapInArrow(words_once, "block long, bucket int, mark long, lengths binary, flat binary")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return made.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(reassemble, f"doc_id {doc_type}, {columns}")


def token_bytes(ranks: Ranks) -> list[bytes | None]:
    """The token-byte table, a row per id."""
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _joined(lists: pa.ListArray, table: pa.Array) -> list[bytes | None]:
    """The token bytes of each list of ids, joined with the table by id and put together; None for null."""
    pieces = table.take(lists.flatten())
    if pieces.null_count:
        raise ValueError("an id has no token")
    at = np.frombuffer(pieces.buffers()[1], "<i8", len(pieces) + 1, pieces.offset * 8) if len(pieces) else np.zeros(1, np.int64)
    data = memoryview(pieces.buffers()[2] or b"")
    ends = at[np.cumsum(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64))]
    return [bytes(data[s:e]) if ok else None for s, e, ok in zip([0, *ends[:-1]], ends, lists.is_valid().to_pylist(), strict=True)] if len(lists) else []


def decode(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """Add `decoded`, the bytes of each row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_joined(batch.column("ids"), table), pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded binary"]))


def digests(docs: DataFrame, ranks: Ranks, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (over the ids as little-endian unsigned 32-bit integers) and decoded_sha256.

    Each text is encoded, its ids are decoded by the token-byte table, and both are digested.
    """
    shared = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def finish() -> Callable[[pa.ListArray], dict[str, pa.Array]]:
        table = pa.array(shared.value, pa.large_binary())

        def digest(lists: pa.ListArray) -> dict[str, pa.Array]:
            flat = memoryview(np.ascontiguousarray(np.asarray(lists.flatten()).astype("<u4"))).cast("B")
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            ends = np.cumsum(size) * 4
            sums = [hashlib.sha256(flat[s:e]).hexdigest() for s, e in zip(ends - size * 4, ends, strict=True)]
            decoded = [hashlib.sha256(x).hexdigest() for x in _joined(lists, table)]
            return {"n_tokens": pa.array(size), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

        return digest

    return encode(docs, ranks, pattern, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
