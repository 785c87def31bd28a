"""Cross-tokenizer alignment: where two vocabularies cut the same bytes, and how often their ids meet in a corpus.

Texts are encoded by A (byte-level BPE) and B (pieces with byte fallback) in one pass over the documents. Byte offsets at
which tokens of both end cut them into groups; a link is a pair of an A and a B token that overlap, so there is a link
for each run of bytes between two neighbouring ends of either. Groups of one A and one B token whose B id is the one that
has the A id's bytes (an array by A id, made once) are the fast path: they are counted in a vector of the length of A's
vocabulary, one per task. Only the other links enter the pair shuffle, summed per block of documents first.

No token of either vocabulary goes on from another character to a space, so texts are cut there into units, and a unit's
tokens and groups are the same wherever it stands. A block (a run of documents of one partition) encodes each distinct
unit once and keeps its documents as codes of units. Blocks are written; the corpus-wide counts of a block's pairs join
it back by (block, position). The counts of the fast path and the highest count of each B id are tables of the
vocabularies' length, so they are broadcast. Results:

- null or empty texts, and texts whose tokens of A or B don't give back space + text (U+2581 in it, for example), have no
  tokens: zeros, and '' for groups; strings of special tokens inside a text are plain text;
- a row per row of the input; repeated rows count as often as they occur; doc_id may be null; other columns are ignored;
- an empty table gives an empty result; a task's memory grows with the longest text (some 100 bytes for each of its bytes).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shareflow.llm.blocks import pack_ints, release, unpack_ints
from shareflow.llm.bpe import cut_exactly
from shareflow.llm.common import written

#: Bytes of text after which a block ends, where a text counts as one byte at least; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


class Vocabularies(NamedTuple):
    """Where the two vocabularies are, and the pattern that cuts texts for A. The paths are read on every executor.

    cut_at_spaces: no match of the pattern goes on from a character that isn't white space to a space, nor looks behind one.
    """

    byte_bpe: str
    pieces: str
    pattern: str
    cut_at_spaces: bool = True


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_bpe_tokens(path: str) -> dict[bytes, int]:
    """Bytes and id of every ordinary token of a byte-level vocabulary; its ids must be in order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model["added_tokens"]}
    vocabulary, letters = model["model"]["vocab"], _byte_letters()
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids aren't in the order of merges")
    return {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in special}


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of every piece; control pieces have none."""
    out = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) or model.is_unknown(k) else piece.replace("▁", " ").encode())
    return out


class _Encoders:
    """The two tokenizers and their tables; made once per Python worker."""

    def __init__(self, where: Vocabularies) -> None:
        tokens = byte_bpe_tokens(where.byte_bpe)
        self.pattern = where.pattern
        self.byte_bpe = tiktoken.Encoding("byte-level", pat_str=where.pattern, mergeable_ranks=tokens, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=where.pieces)
        a = [b""] * (max(tokens.values()) + 1)
        for token, k in tokens.items():
            a[k] = token
        b = piece_bytes(self.pieces)
        self.sizes = len(a), len(b)
        self.length = tuple(np.array([len(t) for t in table], np.int32) for table in (a, b))
        self.bytes = tuple(pa.array(table, pa.large_binary()) for table in (a, b))
        # of several B ids with the same bytes an ordinary piece, not the single byte
        by_bytes = {t: k for k, t in reversed(list(enumerate(b))) if t and self.pieces.is_byte(k)} | {t: k for k, t in reversed(list(enumerate(b))) if t and not self.pieces.is_byte(k)}
        self.same = np.array([by_bytes.get(t, -1) for t in a], np.int64)
        # whether texts can be cut into units; a unit of B is encoded behind a letter, so that its first space isn't doubled
        self.cuts = where.cut_at_spaces and not any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in b)
        self.lead = len(self.pieces.encode("x")) if self.cuts else 0
        # how a token is written in the text of groups: A within and at the end of its group, then B likewise
        self.written = pa.array([f"{k}{end}" for n, ends in ((len(a), ",|"), (len(b), ",;")) for end in ends for k in range(n)], pa.large_string())

    def encode_a(self, unit: str) -> list[int]:
        try:
            return self.byte_bpe.encode_ordinary(unit)
        except BaseException as fault:  # the engine panics where its stack is too small for a run of very many spaces
            if type(fault).__name__ != "PanicException":
                raise
            return [k for piece in cut_exactly(self.pattern, unit) for k in self.byte_bpe._encode_single_piece(piece)]

    def encode_b(self, units: list[str]) -> list[list[int]]:
        if not self.cuts:
            return self.pieces.encode([u[1:] for u in units], num_threads=1)
        return [x[self.lead :] for x in self.pieces.encode([f"x{u}" for u in units], num_threads=1)]


@lru_cache(maxsize=1)
def _encoders(where: Vocabularies) -> _Encoders:
    return _Encoders(where)


class _Aligned(NamedTuple):
    """Of each unit: whether its tokens give back its bytes, its numbers of tokens, groups and links, its groups as text
    (each with a semicolon behind it); and the links, unit after unit."""

    fits: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: pa.Array
    fast: np.ndarray  # links of the fast path: A ids
    n_fast: np.ndarray
    pairs: np.ndarray  # the others: A id * size of B + B id
    n_pairs: np.ndarray


def _joined(ids: np.ndarray, table: pa.Array) -> memoryview:
    """Bytes of all tokens."""
    taken = table.take(pa.array(ids))
    return memoryview(taken.buffers()[2] or b"").cast("B")[: int(np.frombuffer(taken.buffers()[1], "<i8", len(taken) + 1)[-1]) if len(taken) else 0]


def _upto(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _sums(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values up to each end, less those up to the end before."""
    return np.diff(np.concatenate([[0], _upto(values)[ends]]))


def _align(units: list[str], tools: _Encoders) -> _Aligned:
    wanted = [u.encode() for u in units]
    none = np.empty(0, np.int32)
    a = [np.array(tools.encode_a(u), np.int32) for u in units]
    b = [np.array(x, np.int32) for x in tools.encode_b(units)]
    flat = lambda side: np.concatenate(side) if side else none
    both, sizes = (flat(a), flat(b)), [_sums(np.cumsum([len(x) for x in side], dtype=np.int64), n[flat(side)]) for side, n in zip((a, b), tools.length, strict=True)]
    bytes_each = np.fromiter(map(len, wanted), np.int64, len(wanted))
    fits = np.ones(len(units), bool)
    if any((s != bytes_each).any() for s in sizes) or any(_joined(ids, table) != b"".join(wanted) for ids, table in zip(both, tools.bytes, strict=True)):
        fits = np.array([_joined(x, tools.bytes[0]) == w and _joined(y, tools.bytes[1]) == w for x, y, w in zip(a, b, wanted, strict=True)])
        a, b = ([x if ok else none for x, ok in zip(side, fits, strict=True)] for side in (a, b))
        both = flat(a), flat(b)
    n_a, n_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
    unit_end = np.cumsum(np.where(fits, bytes_each, 0))
    # 1 where a token of A ends, 2 where one of B does
    at = np.zeros(int(unit_end[-1]) if len(units) else 0, np.uint8)
    end_a, end_b = (np.cumsum(tools.length[k][both[k]], dtype=np.int64) - 1 for k in (0, 1))
    at[end_a] = 1
    at[end_b] |= 2
    ends = np.flatnonzero(at)
    kind = at[ends]
    shared = kind == 3
    # a link per end: its A token and its B token are the first that don't end before it
    is_a, is_b = kind & 1, kind >> 1
    link_a = both[0][_upto(is_a)[:-1]].astype(np.int64)
    link_b = both[1][_upto(is_b)[:-1]].astype(np.int64)
    single = shared & np.concatenate([[True], shared[:-1]])[: len(shared)]
    fast = single & (tools.same[link_a] == link_b)
    of_unit = np.searchsorted(ends, unit_end)
    # tokens in the order of groups, A before B
    last_a, last_b = at[end_a] == 3, at[end_b] == 3
    group_a, group_b = (_upto(x)[:-1] for x in (last_a, last_b))
    upto_a, upto_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
    order = np.empty(len(end_a) + len(end_b), np.int32)
    order[np.arange(len(end_a)) + upto_b[group_a]] = both[0] + np.where(last_a, tools.sizes[0], 0)
    order[np.arange(len(end_b)) + upto_a[group_b]] = both[1] + 2 * tools.sizes[0] + np.where(last_b, tools.sizes[1], 0)
    taken = tools.written.take(pa.array(order))
    text_end = np.frombuffer(taken.buffers()[1], "<i8", len(taken) + 1)[_upto(n_a + n_b)] if len(order) else np.zeros(len(units) + 1, np.int64)
    return _Aligned(
        fits, n_a, n_b, _sums(of_unit, shared), _sums(of_unit, np.ones(len(ends), np.int8)),
        pa.LargeStringArray.from_buffers(len(units), pa.py_buffer(text_end.astype("<i8")), taken.buffers()[2] or pa.py_buffer(b"")),
        link_a[fast], _sums(of_unit, fast),
        link_a[~fast] * tools.sizes[1] + link_b[~fast], _sums(of_unit, ~fast),
    )


def _blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character of UTF-8 bytes that ends before each place may be white space; any of U+2000 to U+207F counts."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return (one <= 0x20) | (one == 0x7F) | ((two == 0xC2) & (one <= 0xA0)) | wide


def _units(texts: pa.Array, cuts: bool) -> tuple[pa.Array, np.ndarray]:
    """The units of texts in order, each with the space before it, and each text's number of units; none for null and empty."""
    spaced = pc.if_else(pc.equal(pc.fill_null(texts, ""), ""), "", pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), "")).cast(pa.large_string())
    at = np.frombuffer(spaced.buffers()[1], "<i8", len(spaced) + 1, spaced.offset * 8)
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[: at[-1]]
    begins = np.zeros(len(data), bool)
    if cuts:
        spaces = np.flatnonzero(data == 0x20)
        begins[spaces[~_blank(data, spaces)]] = True
    begins[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(begins)
    offsets = np.append(first, len(data)).astype("<i8")
    units = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), spaced.buffers()[2] or pa.py_buffer(b""))
    return units, np.diff(np.searchsorted(first, at))


_STATS = ("n_a", "n_b", "n_groups", "n_links")


def _schema(id_type: pa.DataType) -> pa.Schema:
    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    lists = {"ids": pa.list_(id_type), **dict.fromkeys(_STATS, longs), "sha256": texts, "groups": texts}
    packed = dict.fromkeys(("n_units", "units", "n_fast", "fast", "n_pairs", "codes"), pa.binary())
    return pa.schema({"block": pa.int64(), **lists, **packed, "pairs": longs, "counts": longs})


def _block(number: int, ids: pa.Array, texts: pa.Array, tools: _Encoders, vector: np.ndarray, with_text: bool) -> dict:
    """A block's row; adds its links of the fast path to the vector."""
    units, n_units = _units(texts, tools.cuts)
    coded = units.dictionary_encode()
    codes, doc_end = np.asarray(coded.indices).astype(np.int64), np.cumsum(n_units)
    one = _align(coded.dictionary.to_pylist(), tools)
    # a text counts only if all its units fit
    fits = _sums(doc_end, ~one.fits[codes]) == 0
    codes, n_units = codes[np.repeat(fits, n_units)], np.where(fits, n_units, 0)
    doc_end = np.cumsum(n_units)
    often = np.bincount(codes, minlength=len(one.fits))
    vector += np.bincount(one.fast, np.repeat(often, one.n_fast), len(vector)).astype(np.int64)
    pairs, places = np.unique(one.pairs, return_inverse=True)
    counts = np.bincount(places, np.repeat(often, one.n_pairs), len(pairs)).astype(np.int64)
    taken = one.text.take(pa.array(codes))
    data = memoryview(taken.buffers()[2] or b"")
    text_end = (np.frombuffer(taken.buffers()[1], "<i8", len(taken) + 1)[doc_end] if len(codes) else np.zeros(len(doc_end), np.int64)).tolist()
    # without the semicolon behind the last group
    groups = [data[s : max(s, e - 1)] for s, e in zip([0, *text_end[:-1]], text_end, strict=True)]
    return {
        "block": number,
        "ids": ids.to_pylist(),
        **{f: _sums(doc_end, getattr(one, f)[codes]) for f in _STATS},
        "sha256": [hashlib.sha256(g).hexdigest() if len(g) else "" for g in groups],
        "groups": [str(g, "ascii") for g in groups] if with_text else None,
        **{f: pack_ints(x) for f, x in (("n_units", n_units), ("units", codes), ("n_fast", one.n_fast), ("fast", one.fast), ("n_pairs", one.n_pairs), ("codes", places))},
        "pairs": pairs,
        "counts": counts,
    }


def encoded(docs: DataFrame, where: Vocabularies, with_text: bool = False) -> DataFrame:
    """Blocks of aligned documents, written: a row per block, and a row per task without a block, the vector of the fast path.

    pairs and counts: id pairs (A id times the size of B, plus B id) and how many links of the block, or of the task's
    fast path, hold them linked.
    """
    types = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{f} array<{kind}>" for f, kind in (("ids", types), *((f, "long") for f in _STATS), ("sha256", "string"), ("groups", "string")))
    packed = ", ".join(f"{f} binary" for f in ("n_units", "units", "n_fast", "fast", "n_pairs", "codes"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _encoders(where)
        number, vector = TaskContext.get().partitionId() << 32, np.zeros(tools.sizes[0], np.int64)
        held: list[pa.RecordBatch] = []
        room, kind = BLOCK_BYTES, None

        def row(values: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in kind], schema=kind)

        def block() -> pa.RecordBatch:
            nonlocal number, held, room
            docs = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = row(_block(number, docs.column("doc_id"), docs.column("text"), tools, vector, with_text))
            number, held, room = number + 1, [], BLOCK_BYTES
            release()
            return out

        for batch in batches:
            kind = kind or _schema(batch.schema.field("doc_id").type)
            size = np.cumsum(np.maximum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)), 1), dtype=np.int64)
            begin = 0
            while begin < len(batch):
                before = int(size[begin - 1]) if begin else 0
                # as many documents as fit, one at least when the block is empty
                end = max(int(np.searchsorted(size, before + room, side="right")), begin + (not held))
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                    room -= int(size[end - 1]) - before
                if end < len(batch):
                    yield block()
                begin = end
        if held:
            yield block()
        if kind and vector.any():
            used = np.flatnonzero(vector)
            yield row({"pairs": used * tools.sizes[1] + tools.same[used], "counts": vector[used]})
        release()

    return written(docs.select("doc_id", "text").mapInArrow(task, f"block long, {lists}, {packed}, pairs array<long>, counts array<long>"), "cross-tokens")


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """pair, n (links that hold it, corpus-wide) and best (no pair of its B id has more), written."""
    sums = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    sums = written(sums.withColumn("b", F.col("pair") % size_b), "cross-tokens-pairs")
    # a row per id of B's vocabulary at most
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return written(sums.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "cross-tokens-counts")


def align(docs: DataFrame, where: Vocabularies, with_text: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups (`a1,a2|b1;…`) if with_text."""
    spark = docs.sparkSession
    tools = _encoders(where)
    size_a, size_b = tools.sizes
    blocks = encoded(docs, where, with_text)
    counts = pair_counts(blocks, size_b)
    # counts of the fast path by A id: a row per id of A's vocabulary at most
    fast = spark.createDataFrame([(int(k * size_b + b),) for k, b in enumerate(tools.same) if b >= 0], "pair long")
    n, best = np.zeros(size_a, np.int64), np.zeros(size_a, np.int64)
    for r in counts.join(F.broadcast(fast), "pair", "left_semi").toLocalIterator():
        n[r["pair"] // size_b], best[r["pair"] // size_b] = r["n"], r["best"]
    shared = spark.sparkContext.broadcast((n, best))
    held = blocks.filter("block is not null")
    asked = held.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select("of_block", "at", "n", "best")
    doc_type = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        fast_n, fast_best = shared.value
        (row,) = rows.to_pylist()
        codes = unpack_ints(row["codes"]).astype(np.int64)
        pair_n, pair_best = np.zeros((2, row["n_distinct"]), np.int64)
        if found.num_rows != len(pair_n):
            raise ValueError("answers belong to another version of this block")
        pair_n[np.asarray(found["at"])], pair_best[np.asarray(found["at"])] = np.asarray(found["n"]), np.asarray(found["best"].cast(pa.int64()))
        ints = {x: unpack_ints(row[x]).astype(np.int64) for x in ("n_units", "units", "n_fast", "fast", "n_pairs", "codes")}
        doc_end, fast_end, pair_end = (np.cumsum(ints[x]) for x in ("n_units", "n_fast", "n_pairs"))
        total = lambda of_fast, of_pair: _sums(doc_end, (_sums(fast_end, of_fast[ints["fast"]]) + _sums(pair_end, of_pair[ints["codes"]]))[ints["units"]])
        release()
        out = {"doc_id": pa.array(row["ids"], rows.schema.field("ids").type.value_type), **{x: pa.array(row[x], pa.int64()) for x in _STATS}}
        out |= {"n_best": pa.array(total(fast_best, pair_best)), "count_sum": pa.array(total(fast_n, pair_n)), "groups_sha256": pa.array(row["sha256"], pa.string())}
        return pa.table(out | ({"groups": pa.array(row["groups"], pa.string())} if with_text else {}))

    columns = f"doc_id {doc_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_text
    rows = held.withColumn("n_distinct", F.size("pairs")).drop("pairs", "counts")
    return rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(finish, columns)
