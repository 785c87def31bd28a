"""Dictionary blocks: how a corpus's tokens meet a table of its distinct words without shuffling every occurrence.

A block is a run of documents of one partition. It holds its documents as codes (positions in the block's own sorted
list of distinct tokens, renumbered by frequency) and hands out that list cut into word buckets. A global word job then
shuffles (bucket, block) rows, meets each distinct word of a bucket in one place and answers each row with one value per
word; answers join the block back by its number, and the block puts its documents together by position.

Blocks are written as a table bucketed by block number, so that no later join shuffles the codes again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shareflow.llm.common import shared_dir, shuffle_partitions

#: Tokens after which a block ends, where an empty document counts as one; a longer document is a block of its own.
BLOCK_TOKENS = 1_000_000

_ZSTD = pa.Codec("zstd", compression_level=1)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers, compressed by byte planes of as few bytes as the largest needs."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return np.array([len(values), width], "<i8").tobytes() + _ZSTD.compress(planes, asbytes=True)


def unpack_ints(payload: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(payload, "<i8", 2))
    planes = np.frombuffer(_ZSTD.decompress(memoryview(payload)[16:], n * width, asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(f"<u{width}")


def pack_strings(words: pa.Array) -> bytes:
    words = pa.concat_arrays([words])  # drops any offset
    lengths = np.diff(np.frombuffer(words.buffers()[1], "<i4", len(words) + 1, words.offset * 4)) if len(words) else np.empty(0, "<i4")
    data = words.buffers()[2] or b""
    body = bytes(memoryview(data)[: int(lengths.sum())])
    head = pack_ints(lengths)
    return np.array([len(head), len(body)], "<i8").tobytes() + head + _ZSTD.compress(body, asbytes=True)


def unpack_strings(payload: bytes) -> pa.Array:
    head, size = (int(x) for x in np.frombuffer(payload, "<i8", 2))
    lengths = unpack_ints(payload[16 : 16 + head])
    data = _ZSTD.decompress(memoryview(payload)[16 + head :], size, asbytes=True) if size else b""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<i4")
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def release() -> None:
    """Give memory that Arrow holds back for later to the system: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()


def word_hash(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.empty(0, np.uint64)


#: A column of texts, null but for rare ones, and how to cut one of them into tokens.
Odd = tuple[Column, Callable[[str], list[str]]]


class Blocks(NamedTuple):
    """rows: block, mark, ids (array), marked (array<boolean>), lengths, codes, by_rank; a row per block.

    words: block, bucket, mark, words, counts; a row per block and word bucket that it has words of. counts has how often
    each word occurs in the block's marked documents. mark is a checksum of the block's dictionary.
    """

    rows: DataFrame
    words: DataFrame
    buckets: int


def _emit(ids: list[pa.Array], marked: list[pa.Array], lengths: list[np.ndarray], flat: list[pa.Array], number: int, buckets: int, lower: bool, hashed: bool) -> dict:
    tokens = pa.concat_arrays(flat)
    if lower:
        tokens = pc.ascii_lower(tokens)
    found = tokens.dictionary_encode()
    words, codes = found.dictionary, np.asarray(found.indices)
    size = np.concatenate(lengths)
    flags = np.concatenate([np.asarray(x.cast(pa.uint8())) for x in marked])
    hashes = word_hash(words)
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.asarray(pc.sort_indices(pa.table({"b": bucket, "w": words}), [("b", "ascending"), ("w", "ascending")]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    often = np.bincount(codes, minlength=len(words))
    by_rank = np.argsort(-often, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[by_rank] = np.arange(len(words))
    counts = np.bincount(codes[np.repeat(flags, size).astype(bool)], minlength=len(words))[order]
    words, bucket = words.take(pa.array(order)), bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    mark = zlib.crc32(pack_strings(words))
    # one row for the block, then one for each bucket
    used = [] if hashed else [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    n = len(used)
    return {
        "kind": ["rows"] + ["words"] * n,
        "block": [number] * (n + 1),
        "bucket": [-1, *used],
        "mark": [mark] * (n + 1),
        "ids": [pa.concat_arrays(ids).to_pylist()] + [None] * n,
        "marked": [flags.astype(bool).tolist()] + [None] * n,
        "lengths": [pack_ints(size)] + [None] * n,
        "codes": [pack_ints(rank[codes])] + [None] * n,
        "by_rank": [pack_ints(place[by_rank])] + [None] * n,
        "hashes": [hashes[order].astype("<u8").tobytes() if hashed else None] + [None] * n,
        "words": [None] + [pack_strings(words.slice(cuts[b], cuts[b + 1] - cuts[b])) for b in used],
        "counts": [None] + [pack_ints(counts[cuts[b] : cuts[b + 1]]) for b in used],
    }


def build(docs: DataFrame, tokens: Column, marked: Column | None = None, lower: bool = False, hashed: bool = False, odd: Odd | None = None, block_tokens: int = BLOCK_TOKENS) -> Blocks:
    """Write the blocks of docs (doc_id and the array of strings `tokens`) to the shared folder.

    lower turns A-Z of the tokens into a-z; hashed writes the words' hashes in place of the words. odd gives, for the
    rare rows that the JVM can't cut as they should be, a column of their texts (null for all others) and a function that
    cuts one. Null tokens count as none. Rows may repeat, doc_ids may be null.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    odd_text, cut_odd = odd or (F.lit(None).cast("string"), None)
    source = docs.select("doc_id", odd_text.alias("odd"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"), (F.lit(True) if marked is None else F.coalesce(marked, F.lit(False))).alias("marked"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, block long, bucket int, mark long, ids array<{id_type}>, marked array<boolean>, lengths binary, codes binary, by_rank binary, hashes binary, words binary, counts binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        out = None
        ids, flags, lengths, flat, held = [], [], [], [], 0
        for batch in batches:
            lists = batch.column("tokens")
            if cut_odd and batch.column("odd").null_count < len(batch):
                again = batch.column("odd").to_pylist()
                lists = pa.array([x if t is None else cut_odd(t) for x, t in zip(lists.to_pylist(), again, strict=True)], pa.list_(pa.string()))
            size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            out = _batch_schema(batch.schema.field("doc_id").type)
            begin = 0
            while begin < len(size):
                # as many documents as fit, one at least when the block is empty
                room = np.searchsorted(np.cumsum(np.maximum(size[begin:], 1)), block_tokens - held, side="right")
                end = begin + max(int(room), 0 if held else 1)
                if end > begin:
                    part = lists.slice(begin, end - begin)
                    ids.append(batch.column("doc_id").slice(begin, end - begin))
                    flags.append(batch.column("marked").slice(begin, end - begin))
                    lengths.append(size[begin:end])
                    flat.append(part.flatten())
                    held += int(np.maximum(size[begin:end], 1).sum())
                    begin = end
                if begin < len(size):
                    yield pa.RecordBatch.from_pydict(_emit(ids, flags, lengths, flat, number, buckets, lower, hashed), schema=out)
                    number += 1
                    ids, flags, lengths, flat, held = [], [], [], [], 0
            del batch, lists
            release()
        if ids:
            yield pa.RecordBatch.from_pydict(_emit(ids, flags, lengths, flat, number, buckets, lower, hashed), schema=out)
        release()

    name = f"blocks_{uuid.uuid4().hex}"
    both = source.mapInArrow(cut, schema)
    both.write.partitionBy("kind").bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    return Blocks(
        table.filter("kind = 'rows'").select("block", "mark", "ids", "marked", "lengths", "codes", "by_rank", "hashes"),
        table.filter("kind = 'words'").select("block", "bucket", "mark", "words", "counts"),
        buckets,
    )


def _batch_schema(id_type: pa.DataType) -> pa.Schema:
    fields = [("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("mark", pa.int64()), ("ids", pa.list_(id_type)), ("marked", pa.list_(pa.bool_()))]
    return pa.schema(fields + [(x, pa.binary()) for x in ("lengths", "codes", "by_rank", "hashes", "words", "counts")])


def answers_in_order(answers: pa.Table, mark: int) -> list[dict]:
    """The answers of a block's buckets in order of bucket; they must be for the same dictionary."""
    rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    if any(r["mark"] != mark for r in rows):
        raise ValueError("answers belong to another version of this block")
    return rows


def positions(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's row: for each token its place in the sorted list of words; tokens of each document."""
    return unpack_ints(row["by_rank"]).astype(np.int64)[unpack_ints(row["codes"]).astype(np.int64)], unpack_ints(row["lengths"]).astype(np.int64)
