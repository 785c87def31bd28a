"""Exact top-k by inner product, block at a time with upper bounds.

Vectors are quantised to integers. Candidates are put into clusters around CENTRES centres, fitted on a bounded sample
(SAMPLE_ROWS rows, those of the least hash); every candidate is indexed, in the cluster of its nearest centre, and what the
sample misses costs time, never a result. Clusters are cut into shards, shards into blocks with a forward index (the
block's vectors, in order of the shard's widest dimension) and the greatest and least value of every dimension. For one
query the bound of a block or shard is the sum over dimensions of the larger of weight x greatest and weight x least.

1. A small table of every shard's extremes gives each query the shard of its greatest bound; only that one is written.
2. Each query is answered there: its kth score is a floor for the whole search.
3. The bounds are worked out again, and only shards whose bound reaches the floor are written and searched, each with its
   blocks in descending order of bound until the next bound falls below the kth score so far. Best lists are merged per
   query.

A task holds one shard and at most about SLAB_QUERIES queries, or SLAB_QUERIES queries and SLAB_SHARDS extremes.

- vectors that are null, empty or hold a null or non-finite component take no part, nor do rows with a null vec_id;
- vectors of different lengths aren't compared; a query without any candidate gives no row;
- ties go to the smaller vec_id; repeated rows of a vec_id are separate candidates for others, never for their own query,
  and a repeated query row is asked once for each distinct vector;
- products are exact whatever their size; a score beyond 64 bits is an error, components saturate at 64 bits;
- an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shareflow.llm.common import written

SHARD_ROWS = 8192
#: Centres at most, and rows of the sample that they are fitted on; a centre has CENTRE_ROWS of them at least on average.
CENTRES, SAMPLE_ROWS, CENTRE_ROWS = 256, 16384, 64
SLAB_QUERIES = 2048
SLAB_SHARDS = 4096
BLOCK_ROWS = 256
SCALE = 1024

_FOUND = "query_id long, query_row string, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the floor of SCALE times each component as long, of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return used.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks else pa.array([], pa.int64())
    return np.asarray(flat).reshape(len(column), -1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _exact(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type whose inner products are exact: float64 where they stay below 2**53, 64-bit or Python's integers else."""
    most = int(np.abs(v.astype(object)).max()) * int(np.abs(q.astype(object)).max()) * v.shape[1] if v.size and q.size else 0
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    return v.astype(kind), q.astype(kind)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    zero = q.dtype.type(0) if q.dtype != object else 0
    return np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T


def _search(query_id: int, q: np.ndarray, bounds: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a shard for one query, of those that score `least` or more."""
    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in np.argsort(-bounds, kind="stable"):
        if len(scores) == k and (least is None or scores[-1] > least):
            least = int(scores[-1])
        if least is not None and bounds[b] < least:
            break
        own, forward = blocks[b]
        got = forward @ q
        if got.dtype == object and max(map(abs, got)) >= 2**63:
            raise ValueError("a score doesn't fit into 64 bits")
        got = got.astype(np.int64)
        keep = own != query_id if least is None else (own != query_id) & (got >= least)
        ids, scores = np.concatenate([ids, own[keep]]), np.concatenate([scores, got[keep]])
        top = _best(ids, scores, k)
        ids, scores = ids[top], scores[top]
    return ids, scores


def centres(vectors: DataFrame) -> np.ndarray:
    """Centres of the vectors of the most frequent length of a bounded sample, a row each; none without vectors."""
    order = F.xxhash64("vec_id", "v")
    sample = vectors.select("v", order.alias("at"), "vec_id").orderBy("at", "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()["v"]
    lengths = np.asarray(sample.combine_chunks().value_lengths()) if len(sample) else np.empty(0, int)
    if not len(lengths):
        return np.empty((0, 0))
    dims = np.bincount(lengths).argmax()
    x = _matrix(sample.filter(pa.array(lengths == dims))).astype(np.float64)
    # each centre begins as the row farthest from those before it, then moves to the mean of its rows a few times
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(CENTRES, max(1, len(x) // CENTRE_ROWS)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    found = x[chosen]
    for _ in range(4):
        own = _nearest(x, found)
        n = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def _nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return ((found**2).sum(1) - 2 * x @ found.T).argmin(1)


def placed_by_cluster(candidates: DataFrame) -> DataFrame:
    """vec_id, v, dims and shard of all candidates, from a written table: a shard holds rows of one cluster and about SHARD_ROWS at most.

    Vectors of another length than the centres are a cluster of their own, the last.
    """
    found = centres(candidates)

    def assign(batches):
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            lengths = np.asarray(batch.column("dims"))
            cluster = np.full(len(lengths), len(found), np.int32)
            fits = np.flatnonzero(lengths == found.shape[1]) if len(found) else []
            if len(fits):
                cluster[fits] = _nearest(_matrix(pa.chunked_array([batch.column("v").take(pa.array(fits))])).astype(np.float64), found)
            # a lot that is written with the row, so that repeated rows are spread too
            lot = pa.array(rng.integers(0, 2**62, len(lengths)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), lot], [*batch.schema.names, "cluster", "lot"])

    rows = candidates.select("vec_id", "v", F.size("v").alias("dims")).mapInArrow(assign, "vec_id long, v array<long>, dims int, cluster int, lot long")
    rows = written(rows, "topk-clusters")
    sizes = dict(rows.groupBy("cluster").count().collect())  # CENTRES + 1 rows at most
    parts = F.array(*(F.lit(-(-sizes.get(k, 1) // SHARD_ROWS)) for k in range(len(found) + 1)))
    shard = F.col("cluster").cast("long") * 2**32 + F.col("lot") % F.get(parts, F.col("cluster"))
    return rows.select("vec_id", "v", "dims", shard.alias("shard"))


def _shard_search(k: int):
    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if docs.num_rows and queries.num_rows:
            ids, v = np.asarray(docs["vec_id"].combine_chunks()), _matrix(docs["v"])
            qid, q, least = np.asarray(queries["query_id"].combine_chunks()), _matrix(queries["v"]), queries["least"].to_pylist()
            widest = int((v.max(0).astype(np.float64) - v.min(0)).argmax())
            order = np.lexsort((ids, v[:, widest]))
            v, q = _exact(v[order], q)
            ids = ids[order]
            cuts = range(0, len(ids), BLOCK_ROWS)
            blocks = [(ids[c : c + BLOCK_ROWS], v[c : c + BLOCK_ROWS]) for c in cuts]
            bounds = _bounds(q, np.stack([b.max(0) for _, b in blocks]), np.stack([b.min(0) for _, b in blocks]))
            for i in range(len(qid)):
                got, scores = _search(qid[i], q[i], bounds[i], blocks, k, least[i])
                out.append((np.full(len(got), qid[i]), np.full(len(got), i), got, scores))
        rows = queries["query_row"].combine_chunks() if out else pa.array([], pa.string())
        a, b, c, d = (np.concatenate(x).astype(np.int64) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))
        return pa.table({"query_id": a, "query_row": rows.take(pa.array(b)), "vec_id": c, "score": d})

    return search


def _extremes(rows: pa.Table) -> pa.Table:
    """One row for a shard: its extremes by dimension."""
    v = _matrix(rows["v"])
    kind = pa.list_(pa.int64())
    return pa.table({"shard": rows["shard"][:1], "dims": rows["dims"][:1], "high": pa.array([v.max(0).tolist()], kind), "low": pa.array([v.min(0).tolist()], kind)})


_REACH = "query_id long, query_row string, shard long, bound long, least long"


def _bound_table(pick):
    """A cogrouped function over shards' extremes and queries; pick chooses (query, shard) places from the matrix of bounds.

    Bounds beyond 64 bits count as the greatest number there is.
    """

    def one(shards: pa.Table, queries: pa.Table) -> pa.Table:
        at_query = at_shard = bounds = np.empty(0, np.int64)
        if shards.num_rows and queries.num_rows:
            high, low = _matrix(shards["high"]), _matrix(shards["low"])
            both, q = _exact(np.concatenate([high, low]), _matrix(queries["v"]))
            every = np.clip(_bounds(q, both[: len(high)], both[len(high) :]), -(2**63), 2**63 - 1).astype(np.int64)
            at_query, at_shard = pick(every, shards, queries)
            bounds = every[at_query, at_shard]
        row = pa.array(at_query)
        return pa.table({"query_id": queries["query_id"].take(row), "query_row": queries["query_row"].take(row), "shard": shards["shard"].take(pa.array(at_shard)), "bound": bounds, "least": queries["least"].take(row)})

    return one


def _greatest(bounds: np.ndarray, shards: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Each query's shard of the greatest bound, of equals that of the greatest number."""
    ids = np.asarray(shards["shard"].combine_chunks())
    order = np.argsort(-ids, kind="stable")
    return np.arange(len(bounds)), order[bounds[:, order].argmax(1)]


def _reaching(bounds: np.ndarray, shards: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All pairs whose bound reaches the query's floor, without the shard that the query has been asked in."""
    floor = np.array([-(2**63) if x is None else x for x in queries["least"].to_pylist()], np.int64)
    first = np.asarray(queries["first"].combine_chunks())
    return np.nonzero((bounds >= floor[:, None]) & (np.asarray(shards["shard"].combine_chunks()) != first[:, None]))


def extremes(placed: DataFrame) -> DataFrame:
    """shard, dims, high and low of every shard, written."""
    return written(placed.groupBy("shard", "dims").applyInArrow(_extremes, "shard long, dims int, high array<long>, low array<long>"), "topk-extremes")


def _slabs(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def reach(edges: DataFrame, parts: int, asked: DataFrame, slabs: int, pick) -> DataFrame:
    """query_id, query_row, shard, bound, least of what pick chooses; asked has query_id, query_row, v, dims, least, first."""
    shards = edges.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts))).withColumn("slab", F.expr(f"explode(sequence(0L, {slabs - 1}L))"))
    queries = asked.withColumn("slab", F.pmod(F.xxhash64("query_row"), F.lit(slabs))).withColumn("part", F.expr(f"explode(sequence(0L, {parts - 1}L))"))
    keys = ["part", "slab", "dims"]
    return shards.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_bound_table(pick), _REACH)


def _searched(wanted: DataFrame, asked: DataFrame, slabs: int, placed: DataFrame, k: int) -> DataFrame:
    """The best candidates of the wanted (query_id, query_row, shard, least)."""
    queries = wanted.join(asked, ["query_id", "query_row"]).withColumn("slab", F.pmod(F.xxhash64("query_row"), F.lit(slabs)))
    keys = ["shard", "slab", "dims"]
    slots = queries.select(*(F.col(c).alias(f"{c}_") for c in keys)).distinct()
    dealt = placed.join(slots, (F.col("shard") == F.col("shard_")) & (F.col("dims") == F.col("dims_"))).select("vec_id", "v", *(F.col(f"{c}_").alias(c) for c in keys))
    return dealt.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_shard_search(k), _FOUND)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k candidates of another vec_id with the greatest inner product.

    Both have vec_id and v (array of long), as quantised() gives them.
    """
    placed = placed_by_cluster(candidates)
    row = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    asked = written(queries.distinct().select(F.col("vec_id").alias("query_id"), "v", row.alias("query_row"), F.size("v").alias("dims")), "topk-queries")
    edges, query = extremes(placed), ["query_id", "query_row"]
    parts, slabs = _slabs(edges.count(), SLAB_SHARDS), _slabs(asked.count(), SLAB_QUERIES)
    nothing = F.lit(None).cast("long")
    # of every part of the extremes the best shard, then the best of these
    best = reach(edges, parts, asked.withColumns({"least": nothing, "first": nothing}), slabs, _greatest)
    best = written(best.groupBy(*query).agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")), "topk-best")
    first = written(_searched(best.withColumn("least", nothing), asked, slabs, placed, k), "topk-first")
    floor = first.groupBy(*query).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
    known = asked.join(best.withColumnRenamed("shard", "first"), query).join(floor, query, "left")
    rest = written(reach(edges, parts, known, slabs, _reaching), "topk-reached")
    found = first.unionByName(_searched(rest.select(*query, "shard", "least"), asked, slabs, placed, k))
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from pairs qualify rank <= 10
"""
