"""Near-duplicate documents by an exact Jaccard join of word n-gram sets.

1. Documents become dictionary blocks of word codes. Equal word sequences are one node, the place of its first document.
2. The n-gram hashes of all nodes are counted. An n-gram of one node alone can't be shared, so it takes up the rarest
   places of the node's order without ever being moved; a node with too few shared n-grams has no partner at all.
3. The others order their n-grams rare first; two nodes that reach the threshold share an n-gram of both prefixes.
   At the first one they share, all that they share is there and behind it. So a row of a prefix n-gram holds how many
   n-grams are left from there on (positional filter) and a bitmap of those behind (suffix filter): bit k is the parity of
   the n-grams whose hash falls on k, so two suffixes differ in at least as many n-grams as their bitmaps do in bits.
4. Only components are asked for, so the rows of a prefix n-gram meet in turns: in each turn some of them, drawn by a hash
   of the node, meet all that haven't had their turn and belong to another component. A turn has GROWTH times the rows of
   those before it; the number of turns grows with the logarithm of the largest group, and none is left out. Filters are
   part of the join. A group of many rows is cut into parts, each of which meets the rows whose turn it is.
5. Pairs that pass are verified once each, on their n-grams.

Links are exact for the hashed n-grams (64 bits) and word sequences (128 bits); no pair is dropped for the size of its group.

- words are runs of non white space, A-Z lower-cased; a text of fewer than N words is one n-gram of all its words;
- null, empty and blank texts have no n-grams (n_shingles 0) and are linked with nothing;
- rows that repeat a doc_id and text get the same result; a null doc_id never names a component that has other ids;
- an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shareflow.llm import blocks
from shareflow.llm.common import join_groups, text_or_empty, words, written
from shareflow.llm.components import components

N = 5
#: Least similarity, in percent.
PERCENT = 80
#: Rows of a group that have the first turn, and by what the rows up to a turn grow from each to the next.
FIRST_TURN, GROWTH = 8, 8
#: Rows of a group that one part of it holds.
PART_ROWS = 4096
#: 64-bit words of a suffix's parity bitmap.
WORDS = 4

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _PRIME, np.uint64), dtype=np.uint64)


def _stream(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a block's documents one after the other, and the words of each document."""
    place, size = blocks.positions(row)
    return np.frombuffer(row["hashes"], "<u8")[place] if len(place) else np.empty(0, np.uint64), size


def _signatures(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each document's word sequence, and its number of words."""
    h, size = _stream(row)
    begins, full = np.cumsum(size) - size, size > 0
    at = np.arange(len(h), dtype=np.uint64) - np.repeat(begins, size).astype(np.uint64)
    out = []
    for seed in (np.uint64(1), np.uint64(2)):
        one = np.zeros(len(size), np.uint64)
        if full.any():
            one[full] = np.add.reduceat(_mix(h + _mix(at * _PRIME + seed)), begins[full])
        out.append(_mix(one + size.astype(np.uint64) * _PRIME + seed))
    return *out, size


def _grams(row: dict, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct n-grams of the chosen documents, in order of hash."""
    h, size = _stream(row)
    ends = np.cumsum(size)
    begins = ends - size
    picked = np.zeros(len(size), bool)
    picked[chosen] = True
    doc = np.repeat(np.arange(len(size)), size)
    hashes, docs = [], []
    if len(h) >= n:
        rolled = np.zeros(len(h) - n + 1, np.uint64)
        for j, p in enumerate(_powers(n)):
            rolled += h[j : len(h) - n + 1 + j] * p
        inside = (np.arange(len(rolled)) + n <= ends[doc[: len(rolled)]]) & picked[doc[: len(rolled)]]
        hashes.append(_mix(rolled[inside]))
        docs.append(doc[: len(rolled)][inside])
    for length in range(1, n):  # a short document is one n-gram
        short = np.flatnonzero((size == length) & picked)
        total = np.full(len(short), length, np.uint64)
        for j, p in enumerate(_powers(length)):
            total += h[begins[short] + j] * p
        hashes.append(_mix(total))
        docs.append(short)
    hash_, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((doc, hash_))
    hash_, doc = hash_[order], doc[order]
    new = np.ones(len(hash_), bool)
    new[1:] = (hash_[1:] != hash_[:-1]) | (doc[1:] != doc[:-1])
    return hash_[new], doc[new]


def _keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 48-bit keys under which sorted hashes are counted: distinct keys, how often each occurs, key number of each hash."""
    return _runs(hashes >> np.uint64(16))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.cumsum(new) - 1
    return keys[new], np.bincount(number, minlength=int(new.sum())), number


def _bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted keys begins and ends."""
    edges = [(b << 48) // buckets for b in range(buckets + 1)]
    return np.searchsorted(keys, np.array(edges, np.uint64))


#: A node's number is its first document's place: partition, block of the partition and document of the block.
PLACE_BITS = 21


def _place(block: int, n: int) -> np.ndarray:
    partition, of_partition = block >> 32, block & (1 << 32) - 1
    if max(partition, of_partition, n - 1) >> PLACE_BITS:
        raise ValueError(f"block {block} of {n} documents has no place number")
    return (partition << 2 * PLACE_BITS | of_partition << PLACE_BITS) + np.arange(n)


def _documents(made: blocks.Blocks, id_type: str) -> DataFrame:
    """A row per document: doc_id, place, high and low half of its word sequence's hash (null without words)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                high, low, size = _signatures(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["ids"], batch.schema.field("ids").type.value_type),
                        "place": _place(row["block"], len(size)),
                        "high": pa.array(high.view(np.int64), pa.int64(), mask=size == 0),
                        "low": pa.array(low.view(np.int64), pa.int64(), mask=size == 0),
                    }
                )

    return written(made.rows.mapInArrow(one, f"doc_id {id_type}, place long, high long, low long"), "ngram-documents")


def _chosen(texts: DataFrame) -> DataFrame:
    """For each block the numbers of its documents that are nodes, in order, and the nodes."""
    part = (1 << PLACE_BITS) - 1
    block = F.shiftleft(F.shiftright("node", 2 * PLACE_BITS), 32).bitwiseOR(F.shiftright("node", PLACE_BITS).bitwiseAND(F.lit(part).cast("long")))
    at = texts.select(block.alias("block"), F.struct(F.col("node").bitwiseAND(F.lit(part).cast("long")).cast("int").alias("number"), "node").alias("at"))
    # a block's documents are bounded by the block
    picks = at.groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("picks"))
    return written(picks.select("block", "picks.number", "picks.node").toDF("block", "numbers", "nodes"), "ngram-chosen")


def _counted(made: blocks.Blocks, chosen: DataFrame, n: int) -> DataFrame:
    """For each block and bucket, in how many nodes each of the block's keys of that bucket occurs."""
    buckets = made.buckets

    def keys(rows: pa.Table, picks: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist() if picks.num_rows else []:
            found, count, _ = _keys(_grams(row, _picked(picks)[0], n)[0])
            cuts = _bucket_cuts(found, buckets)
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                out.append({"block": row["block"], "bucket": int(b), "mark": row["mark"], "keys": blocks.pack_ints(np.diff(found[part], prepend=np.uint64((int(b) << 48) // buckets))), "counts": blocks.pack_ints(count[part])})
        return pa.Table.from_pylist(out, schema=_KEYS)

    def add(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        parts = [np.cumsum(blocks.unpack_ints(x).astype(np.uint64), dtype=np.uint64) for x in rows["keys"].to_pylist()]
        counts = np.concatenate([blocks.unpack_ints(x) for x in rows["counts"].to_pylist()])
        _, number = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(number, counts).astype(np.int64)[number]
        ends = np.cumsum([0, *map(len, parts)])
        packed = [blocks.pack_ints(total[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": rows["block"], "bucket": pa.array([bucket] * len(packed), pa.int32()), "mark": rows["mark"], "totals": pa.array(packed, pa.binary())})

    asked = made.rows.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(keys, "block long, bucket int, mark long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(add, "block long, bucket int, mark long, totals binary")


_KEYS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("mark", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _picked(picks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.array(picks["numbers"][0].as_py()), np.array(picks["nodes"][0].as_py())


def _suffix_parities(grams: np.ndarray, n_prefix: int) -> np.ndarray:
    """For each of the first n_prefix n-grams the bitmap of those behind it, WORDS 64-bit words each: bit k is the parity of those that fall on k."""
    bit = (grams >> 8) & (64 * WORDS - 1)
    one = np.zeros((len(grams), WORDS), np.uint64)
    one[np.arange(len(grams)), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
    behind = np.bitwise_xor.reduce(one, axis=0) ^ np.bitwise_xor.accumulate(one[:n_prefix], axis=0)
    return behind.view(np.int64).reshape(-1)


def least_shared(size: np.ndarray, percent: int) -> np.ndarray:
    """The fewest n-grams that a set of this size must share with any partner."""
    return -(-size * percent // 100)


def _ordered(made: blocks.Blocks, chosen: DataFrame, totals: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per node: node, size, and if it can have a partner its shared n-grams rare first, how many are prefix, and suffix bitmaps."""
    gathered = chosen.select("block", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("mark"), F.lit(None).cast("binary").alias("totals"), "numbers", "nodes").unionByName(
        totals.select("*", F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("array<long>").alias("nodes"))
    )

    def order(rows: pa.Table, given: pa.Table) -> pa.Table:
        out = {"node": [], "size": [], "grams": [], "n_prefix": [], "bits": []}
        picks = given.filter(given["bucket"].is_null()) if given.num_rows else given
        for row in rows.to_pylist() if picks.num_rows else []:
            numbers, nodes = _picked(picks)
            hashes, doc = _grams(row, numbers, n)
            got = blocks.answers_in_order(given.filter(given["bucket"].is_valid()), row["mark"])
            total = np.concatenate([blocks.unpack_ints(a["totals"]) for a in got] or [np.empty(0, int)]).astype(np.int64)
            often = total[_keys(hashes)[2]] if len(hashes) else np.empty(0, np.int64)
            n_docs = int(max(numbers)) + 1
            size, shared = np.bincount(doc, minlength=n_docs), np.bincount(doc[often > 1], minlength=n_docs)
            able = (shared >= least_shared(size, percent)) & (size > 0)
            part = able[doc] & (often > 1)
            hashes, doc, often = hashes[part], doc[part], often[part]
            rank = np.lexsort((hashes, often, doc))
            hashes, ends = hashes[rank].view(np.int64), np.cumsum(np.bincount(doc, minlength=n_docs))
            for number, node in zip(numbers, nodes, strict=True):
                k = int(size[number])
                out["node"].append(node)
                out["size"].append(k)
                prefix = k - int(least_shared(np.int64(k), percent)) + 1 - (k - int(shared[number]))
                if able[number] and prefix > 0:
                    out["grams"].append(hashes[ends[number] - shared[number] : ends[number]])
                    out["n_prefix"].append(prefix)
                    out["bits"].append(_suffix_parities(out["grams"][-1], prefix))
                else:
                    for c in ("grams", "n_prefix", "bits"):
                        out[c].append(None)
        types = {"node": pa.int64(), "size": pa.int32(), "grams": pa.list_(pa.int64()), "n_prefix": pa.int32(), "bits": pa.list_(pa.int64())}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    ordered = made.rows.groupBy("block").cogroup(gathered.groupBy("block")).applyInArrow(order, "node long, size int, grams array<long>, n_prefix int, bits array<long>")
    return written(ordered, "ngram-nodes")


#: What a prefix row says: node, size of its set, shared n-grams from this one on, component, turn, bitmap of those behind.
MEMBER = ["node", "size", "left", "root", *(f"bits{k}" for k in range(WORDS))]


def _other(column: str) -> str:
    return "other" if column == "node" else f"other_{column}"


def _may_link(percent: int) -> Column:
    """Length, positional and suffix filter over a prefix n-gram's row and another of its rows (other_ columns).

    They hold at the first n-gram that two linked nodes share; a pair may pass at others too.
    """
    need = F.ceil((F.col("size") + F.col("other_size")) * F.lit(percent) / F.lit(100 + percent))
    length = F.least("size", "other_size") * 100 >= F.greatest("size", "other_size") * percent
    positional = F.least("left", "other_left") >= need
    apart = sum((F.bit_count(F.col(f"bits{k}").bitwiseXOR(F.col(f"other_bits{k}"))) for k in range(WORDS)), F.lit(0))
    suffix = F.col("left") + F.col("other_left") - apart >= need * 2
    return length & positional & suffix


def _prefix_rows(nodes: DataFrame) -> DataFrame:
    """A row per prefix n-gram that several nodes have: MEMBER but root, gram, turn, and the parts of its group."""
    grams = nodes.select("node", "size", F.size("grams").alias("shared"), "bits", F.posexplode(F.slice("grams", F.lit(1), F.col("n_prefix"))).alias("pos", "gram"))
    known = ["node", "size", (F.col("shared") - F.col("pos")).alias("left"), *(F.col("bits")[F.col("pos") * WORDS + k].alias(f"bits{k}") for k in range(WORDS))]
    met = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the same draw for all n-grams of a node, so that groups of the same nodes compare the same pairs
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n")
    turn = F.when(drawn < FIRST_TURN, 0).otherwise(F.floor(F.log(drawn / FIRST_TURN) / F.log(F.lit(float(GROWTH)))) + 1).cast("int")
    parts = (F.lit(1) + F.expr(f"n div {PART_ROWS}")).cast("int")
    rows = grams.select("gram", *known).join(met, "gram").select("gram", "node", "size", "left", *(f"bits{k}" for k in range(WORDS)), turn.alias("turn"), parts.alias("parts"))
    return written(rows, "ngram-prefix")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, size_a, size_b) whose n-gram sets reach the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return full.filter(common * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent).select("a", "b")


def _linked(nodes: DataFrame, percent: int) -> DataFrame:
    """node and root of the nodes that links connect to a lesser node."""
    spark: SparkSession = nodes.sparkSession
    prefix = _prefix_rows(nodes)
    turns = prefix.agg(F.max("turn")).first()[0]
    roots = spark.createDataFrame([], "node long, root long")
    seen = spark.createDataFrame([], "a long, b long")
    for turn in range(-1 if turns is None else turns + 1):
        left = prefix.filter(F.col("turn") >= turn)
        rows = written(left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "ngram-rows") if turn else left.withColumn("root", F.col("node"))
        asking = rows.filter(F.col("turn") == turn).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asking = asking.select("gram", "part", *(F.col(c).alias(_other(c)) for c in MEMBER))
        asked = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
        meet = asked.join(asking, ["gram", "part"]).filter((F.col("root") != F.col("other_root")) & ((F.col("turn") > turn) | (F.col("node") < F.col("other"))) & _may_link(percent))
        first = F.col("node") < F.col("other")
        ends = (("node", "other", "a"), ("size", "other_size", "size_a"), ("other", "node", "b"), ("other_size", "size", "size_b"))
        pairs = meet.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in ends)).distinct()
        pairs = written(pairs.join(seen, ["a", "b"], "left_anti") if turn else pairs, "ngram-pairs")
        links = written(_verified(pairs, nodes, percent), "ngram-links")
        seen = seen.unionByName(pairs.select("a", "b"))
        if links.isEmpty():
            continue
        of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        new = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v")) if turn else links.toDF("u", "v")
        # a root with its members is a star already: with the new links it is all that connects
        roots = components(new.unionByName(roots.toDF("u", "v")) if turn else new)
    return roots


def ngram_join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of docs; component_id is the least doc_id reachable by links."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = blocks.build(docs, words(text_or_empty()), lower=True, hashed=True)
    documents = _documents(made, id_type)
    texts = written(documents.filter("low is not null").groupBy("high", "low").agg(F.min("place").alias("node"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_rows")), "ngram-texts")
    chosen = _chosen(texts)
    nodes = _ordered(made, chosen, _counted(made, chosen, n), n, percent)
    roots = _linked(nodes.filter("grams is not null"), percent)
    # every node of a component, its root too, with the component's least id
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(texts.select("node", "least_id"), "node")
    named = members.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
    named = join_groups(members.select("node", "root"), named, ["root"]).select("node", "component_id")
    sized = texts.join(nodes.select("node", "size"), "node").join(named, "node", "left")
    sized = sized.select("high", "low", "n_rows", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "least_id").alias("component_id"))
    found = join_groups(documents.select("doc_id", "high", "low"), sized, ["high", "low"])
    return found.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (
  select a, b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * o >= 80 * (x.n + y.n - o)),
e as (select a as u, b as v from l union select b, a from l),
reach(u, v) as (select u, v from e union select r.u, e.v from reach r join e on r.v = e.u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.v), d.doc_id)) as component_id
from documents d left join n using (doc_id) left join reach r on r.u = d.doc_id group by d.doc_id, n.n
"""
