"""Language-model scores by Brown classes: an exchange clustering of all training words, then a class bigram model.

Words are grouped into classes by batch exchange: with the class bigram counts of the last round fixed, every word moves
to the class that gives its neighbours and itself the greatest likelihood; then counts are taken again. Words that move
at the same time can get in each other's way, so the likelihood of the training texts is worked out from the counts of
every round: a round that doesn't raise it is taken back, and one that hardly raises it is the last. The most frequent words start as classes
of their own and everything else as one class, so the first round already splits by context.

Spark alternates two jobs over dictionary blocks. A block job walks the blocks' codes with the current class of each
word and returns, per word bucket, how often each class stood left and right of a word. A bucket job adds those counts
up over all blocks and moves the words. Only the class bigram counts (classes squared) and totals reach the driver.

The model: P(token | previous) = P(class | previous class) x P(token | class), add-one in both; in every class one share is
kept for a word never seen. A word without training count is an unseen word of some class, and the word after it is
predicted from the classes' mean, weighted by their words seen once. Each text ends with an end token, a class of its own.

- null text counts as empty: it has the end token alone; null doc_ids count as the empty string in the split;
- rows that repeat a doc_id are scored and counted each; without training rows all tokens are unknown; an empty table
  gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shareflow.llm import blocks
from shareflow.llm.common import text_or_empty, words, written

#: Bounds of the number of classes, which is the square root of the number of distinct training words between them.
LEAST_CLASSES, MOST_CLASSES = 32, 64
#: A round that gains less than this, in natural log likelihood per training token, is the last: 0.02 is a perplexity lower by 2%.
LEAST_GAIN = 0.02
#: Neighbour counts that are weighted at a time, each with a row of numbers per class.
WEIGHTED = 1 << 14


class Totals(NamedTuple):
    tokens: int
    types: int
    texts: int


def _ragged(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([blocks.unpack_ints(r[name]) for r in rows] or [np.empty(0, np.uint8)])


def _vocabulary(made: blocks.Blocks, first: int = MOST_CLASSES) -> DataFrame:
    """kind 'state': a bucket's training counts by word number; kind 'answers': the numbers of a block's words in its bucket.

    top has the `first` most frequent words of each bucket.
    """

    def one(rows: pa.Table) -> pa.Table:
        parts = [blocks.unpack_strings(x) for x in rows["words"].to_pylist()]
        found = pa.concat_arrays(parts).dictionary_encode()
        number = np.asarray(found.indices).astype(np.int64)
        seen = np.concatenate([blocks.unpack_ints(x) for x in rows["counts"].to_pylist()]).astype(np.int64)
        counts = np.bincount(number, weights=seen, minlength=len(found.dictionary)).astype(np.int64)
        top = np.argsort(-counts, kind="stable")[:first]
        cuts = np.cumsum([0, *map(len, parts)])
        n = rows.num_rows
        return pa.table(
            {
                "kind": ["state"] + ["answers"] * n,
                "bucket": pa.array(rows["bucket"].to_pylist()[:1] * (n + 1), pa.int32()),
                "block": pa.array([None, *rows["block"].to_pylist()], pa.int64()),
                "mark": pa.array([None, *rows["mark"].to_pylist()], pa.int64()),
                "place": pa.array([None] + [blocks.pack_ints(number[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                "counts": pa.array([blocks.pack_ints(counts)] + [None] * n, pa.binary()),
                "n_tokens": pa.array([int(counts.sum())] + [None] * n, pa.int64()),
                "n_types": pa.array([int((counts > 0).sum())] + [None] * n, pa.int64()),
                "top": pa.array([[{"count": int(counts[i]), "number": int(i)} for i in top]] + [None] * n, pa.list_(pa.struct([("count", pa.int64()), ("number", pa.int64())]))),
            }
        )

    schema = "kind string, bucket int, block long, mark long, place binary, counts binary, n_tokens long, n_types long, top array<struct<count:long,number:long>>"
    return written(made.words.groupBy("bucket").applyInArrow(one, schema), "lm-vocabulary")


def _first_classes(vocabulary: DataFrame, classes: int) -> dict[tuple[int, int], int]:
    """(bucket, word number) of the most frequent words and their class; all others are in class 0."""
    top = vocabulary.filter("kind = 'state'").select("bucket", F.explode("top").alias("t")).select("bucket", "t.count", "t.number")
    rows = top.orderBy(F.desc("count"), "bucket", "number").limit(classes - 1).collect()
    return {(r["bucket"], r["number"]): k + 1 for k, r in enumerate(rows)}


def _seeded(vocabulary: DataFrame, seeds: dict[tuple[int, int], int]) -> DataFrame:
    """The answers of the vocabulary with each word's first class."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("place").to_pylist(), strict=True):
                place = blocks.unpack_ints(payload)
                given = np.zeros(len(place), np.int32)
                for (b, number), k in seeds.items():
                    if b == bucket:
                        given[place == number] = k
                out.append(blocks.pack_ints(given))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "classes"])

    rows = vocabulary.filter("kind = 'answers'").select("bucket", "block", "mark", "place")
    return rows.mapInArrow(one, "bucket int, block long, mark long, place binary, classes binary")


class _Walk(NamedTuple):
    """The tokens of a block: word place, own, left and right class, and where documents begin and end."""

    answers: list[dict]
    place: np.ndarray
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    marked: np.ndarray


def _walk(row: dict, answers: pa.Table, classes: int) -> _Walk:
    got = blocks.answers_in_order(answers, row["mark"])
    given = _ragged(got, "classes").astype(np.int32)  # packed in as few bytes as they need, but a boundary's number may need more
    place, size = blocks.positions(row)
    own = given[place] if len(place) else np.empty(0, np.int32)
    left, right = np.empty_like(own), np.empty_like(own)
    left[1:], right[:-1] = own[:-1], own[1:]
    ends = np.cumsum(size)
    full = size > 0
    left[(ends - size)[full]] = classes
    right[ends[full] - 1] = classes
    return _Walk(got, place, own, left, right, size, np.array(row["marked"], dtype=bool))


def _sparse(cells: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in cells, all below room, and how often each occurs; sorted or counted, whichever takes less."""
    if room > 16 * len(cells):
        return np.unique(cells, return_counts=True)
    counts = np.bincount(cells, minlength=room)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _pairs(walk: _Walk, classes: int) -> np.ndarray:
    """Counts of (left class, own class) over the marked documents; the boundary has number `classes`."""
    width = classes + 1
    of_token = np.repeat(walk.marked, walk.size)
    inner = np.bincount(walk.left[of_token].astype(np.int64) * width + walk.own[of_token], minlength=width * width)
    full = walk.marked & (walk.size > 0)
    last = walk.own[np.cumsum(walk.size)[full] - 1]
    inner += np.bincount(last.astype(np.int64) * width + classes, minlength=width * width)
    inner[classes * width + classes] += int((walk.marked & (walk.size == 0)).sum())
    return inner


def _count(made: blocks.Blocks, answers: DataFrame, classes: int, contexts: bool) -> DataFrame:
    """kind 'pairs': a block's class bigram counts; kind 'contexts' (if asked for): its words' neighbours by bucket."""

    def one(rows: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            walk = _walk(row, given, classes)
            out.append({"kind": "pairs", "pairs": _pairs(walk, classes).tolist()})
            if not contexts:
                continue
            width, of_token = classes + 1, np.repeat(walk.marked, walk.size)
            sizes = [len(blocks.unpack_ints(a["place"])) for a in walk.answers]
            cuts, place = np.cumsum([0, *sizes]), walk.place[of_token]
            sides = [_sparse(place * width + x[of_token], int(cuts[-1]) * width) for x in (walk.left, walk.right)]
            for k, a in enumerate(walk.answers):
                cells = {"kind": "contexts", "bucket": a["bucket"], "block": row["block"], "mark": row["mark"], "place": a["place"], "classes": a["classes"]}
                for side, (at, n) in zip(("left", "right"), sides, strict=True):
                    s, e = np.searchsorted(at, [cuts[k] * width, cuts[k + 1] * width])
                    cells |= {f"{side}_at": blocks.pack_ints(np.diff(at[s:e] - cuts[k] * width, prepend=0)), f"{side}_n": blocks.pack_ints(n[s:e])}
                out.append(cells)
        return pa.Table.from_pylist(out, schema=_COUNTED)

    counted = made.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, _COUNTED_DDL)
    return written(counted, "lm-counts")


_COUNTED_DDL = "kind string, bucket int, block long, mark long, place binary, classes binary, left_at binary, left_n binary, right_at binary, right_n binary, pairs array<long>"
_COUNTED = pa.schema(
    [("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("mark", pa.int64())]
    + [(x, pa.binary()) for x in ("place", "classes", "left_at", "left_n", "right_at", "right_n")]
    + [("pairs", pa.list_(pa.int64()))]
)


def _pair_counts(counted: DataFrame, classes: int) -> np.ndarray:
    """The sum of all blocks' class bigram counts, as a matrix from left to own class."""
    width = classes + 1
    cells = counted.filter("kind = 'pairs'").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(width * width)
    for r in cells.collect():  # classes squared rows
        out[r["at"]] = r["n"]
    return out.reshape(width, width)


def likelihood(pairs: np.ndarray) -> float:
    """The log-likelihood of the training texts under class bigrams, but for a term that no move changes."""
    entropy = lambda n: float((n * np.log(np.maximum(n, 1))).sum())
    return entropy(pairs) - entropy(pairs.sum(axis=0)) - entropy(pairs.sum(axis=1))


def _transitions(pairs: np.ndarray) -> np.ndarray:
    return (pairs + 1) / (pairs.sum(axis=1, keepdims=True) + pairs.shape[1])


def _best(cells: np.ndarray, seen: np.ndarray, weights: np.ndarray, counts: np.ndarray, price: np.ndarray) -> np.ndarray:
    """The class of greatest gain for each word, 0 for words without neighbours in training texts.

    cells has (word number x rows of weights + row of weights) for each neighbour count in seen; cells may repeat.
    """
    given, rows = np.zeros(len(counts), np.int32), len(weights)
    order = np.argsort(cells, kind="stable")
    cells, seen = cells[order], seen[order]
    firsts = np.flatnonzero(np.diff(cells, prepend=-1))
    if not len(firsts):
        return given
    cells, seen = cells[firsts], np.add.reduceat(seen, firsts)
    word = cells // rows
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    ends = np.append(begins[1:], len(cells))
    full = np.flatnonzero(ends - begins >= rows // 8)
    for k in range(0, len(full), max(WEIGHTED // rows, 1)):
        # words with many neighbours as rows of a matrix
        of = full[k : k + max(WEIGHTED // rows, 1)]
        dense = np.zeros((len(of), rows))
        for i, w in enumerate(of):
            dense[i, cells[begins[w] : ends[w]] % rows] = seen[begins[w] : ends[w]]
        given[word[begins[of]]] = (dense @ weights - counts[word[begins[of]], None] * price).argmax(axis=1)
    few = np.ones(len(begins), bool)
    few[full] = False
    rest = np.repeat(few, ends - begins)
    cells, seen, word = cells[rest], seen[rest], word[rest]
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    ends = np.append(begins[1:], len(cells))
    k = 0
    while k < len(begins):
        # whole words, one at least
        stop = max(int(np.searchsorted(ends, begins[k] + WEIGHTED, side="right")), k + 1)
        a, b = begins[k], ends[stop - 1]
        numbers = word[begins[k:stop]]
        gain = np.add.reduceat(weights[cells[a:b] % rows] * seen[a:b, None], begins[k:stop] - a, axis=0)
        given[numbers] = (gain - counts[numbers, None] * price).argmax(axis=1)
        k = stop
    return given


def _move(counted: DataFrame, vocabulary: DataFrame, pairs: np.ndarray, classes: int) -> DataFrame:
    """One exchange: kind 'answers' with the new class of each block's words, kind 'state' with counts and classes of a bucket."""
    width = classes + 1
    log = np.log(_transitions(pairs))
    own = pairs.sum(axis=0)[:classes]
    # what a neighbour of each class, left then right, gives a word of each class
    weights, price = np.concatenate([log[:, :classes], log[:classes, :].T]), np.log(own + 1)

    def one(rows: pa.Table, state: pa.Table) -> pa.Table:
        counts = blocks.unpack_ints(state["counts"][0].as_py()).astype(np.int64)
        places = [blocks.unpack_ints(x) for x in rows["place"].to_pylist()]
        cells, seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, side in enumerate(("left", "right")):
            for place, at, n in zip(places, rows[f"{side}_at"].to_pylist(), rows[f"{side}_n"].to_pylist(), strict=True):
                where = np.cumsum(blocks.unpack_ints(at).astype(np.int64))
                cells.append((place[where // width].astype(np.int64) * 2 + k) * width + where % width)
                seen.append(blocks.unpack_ints(n).astype(np.int64))
        given = _best(np.concatenate(cells), np.concatenate(seen), weights, counts, price)
        once = np.bincount(given[counts == 1], minlength=classes)
        types = np.bincount(given[counts > 0], minlength=classes)
        n = rows.num_rows
        return pa.table(
            {
                "kind": ["answers"] * n + ["state"],
                "bucket": pa.array(rows["bucket"].to_pylist() + state["bucket"].to_pylist(), pa.int32()),
                "block": pa.array([*rows["block"].to_pylist(), None], pa.int64()),
                "mark": pa.array([*rows["mark"].to_pylist(), None], pa.int64()),
                "place": pa.array([*rows["place"].to_pylist(), None], pa.binary()),
                "classes": pa.array([blocks.pack_ints(given[p]) for p in places] + [None], pa.binary()),
                "counts": pa.array([blocks.pack_ints(counts[p]) for p in places] + [None], pa.binary()),
                "types": pa.array([None] * n + [types.tolist()], pa.list_(pa.int64())),
                "once": pa.array([None] * n + [once.tolist()], pa.list_(pa.int64())),
            }
        )

    schema = "kind string, bucket int, block long, mark long, place binary, classes binary, counts binary, types array<long>, once array<long>"
    contexts = counted.filter("kind = 'contexts'").drop("kind", "pairs", "classes").groupBy("bucket")
    state = vocabulary.filter("kind = 'state'").select("bucket", "counts").groupBy("bucket")
    return written(contexts.cogroup(state).applyInArrow(one, schema), "lm-classes")


def _class_sums(moved: DataFrame, name: str, classes: int) -> np.ndarray:
    out = np.zeros(classes)
    for r in moved.filter("kind = 'state'").select(F.posexplode(name).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def _scores(made: blocks.Blocks, moved: DataFrame, totals: Totals, pairs: np.ndarray, types: np.ndarray, once: np.ndarray, id_type: str) -> DataFrame:
    classes = len(types)
    known = _transitions(pairs)
    after_unknown = (once + 1) / (once + 1).sum() @ known[:classes]
    table = np.log10(np.vstack([known, after_unknown]))
    room = pairs.sum(axis=0)[:classes] + types + 1
    unseen = np.log10((10.0 ** table[:, :classes]) @ (1 / room))
    log_room, base_room = np.log10(room), np.log10(totals.tokens + totals.types + 1)
    base_end, end_known = np.log10(totals.texts + 1) - base_room, int(totals.texts > 0)

    def one(rows: pa.Table, given: pa.Table) -> pa.Table:
        parts = []
        for row in rows.to_pylist():
            walk = _walk(row, given, classes)
            counts = _ragged(walk.answers, "counts").astype(np.int64)
            own_n = counts[walk.place] if len(walk.place) else np.empty(0, np.int64)
            ends = np.cumsum(walk.size)
            begins, full = ends - walk.size, walk.size > 0
            state = np.where(own_n > 0, walk.own, classes + 1).astype(np.int64)
            left = np.empty_like(state)
            left[1:] = state[:-1]
            left[begins[full]] = classes
            token = np.where(own_n > 0, table[left, np.minimum(state, classes)] + np.log10(own_n + 1) - log_room[np.minimum(walk.own, classes - 1)], unseen[left])
            last = np.full(len(walk.size), classes)
            last[full] = state[ends[full] - 1]
            add = lambda x: _sums(x, begins, full)
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["ids"], rows.schema.field("ids").type.value_type),
                        "held_out": ~walk.marked,
                        "n_tokens": walk.size + 1,
                        "n_known": add((own_n > 0).astype(np.float64)).astype(np.int64) + end_known,
                        "train_tokens": np.full(len(walk.size), totals.tokens),
                        "base_score": add(np.log10(own_n + 1) - base_room) + base_end,
                        "score": add(token) + table[last, classes],
                    }
                )
            )
        return pa.concat_tables(parts)

    answers = moved.filter("kind = 'answers'").select("bucket", "block", "mark", "classes", "counts")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return made.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)


def _sums(values: np.ndarray, begins: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begins))
    if full.any():
        out[full] = np.add.reduceat(values, begins[full])
    return out


class Clusters(NamedTuple):
    """Classes of all words with their counts, class bigram counts, and the likelihood after each round that was kept."""

    moved: DataFrame
    pairs: np.ndarray
    likelihoods: list[float]


def cluster(made: blocks.Blocks, vocabulary: DataFrame, classes: int, rounds: int | None = None, least_gain: float = LEAST_GAIN) -> Clusters:
    """Exchange clustering, a round at least, until a round gains less than least_gain per token, or `rounds` rounds are done.

    A round that doesn't raise the likelihood is taken back.
    """
    if classes < 1 or (rounds is not None and rounds < 1) or (rounds is None and least_gain <= 0):
        raise ValueError("there must be a class, a round and an end at least")
    counted = _count(made, _seeded(vocabulary, _first_classes(vocabulary, classes)), classes, contexts=True)
    pairs, kept = _pair_counts(counted, classes), []
    best: Clusters | None = None
    while best is None or len(best.likelihoods) != rounds:
        moved = _move(counted, vocabulary, pairs, classes)
        counted = _count(made, moved.filter("kind = 'answers'").select("bucket", "block", "mark", "place", "classes"), classes, contexts=len(kept) + 1 != rounds)
        pairs = _pair_counts(counted, classes)
        kept.append(likelihood(pairs))
        gained = kept[-1] - kept[-2] if best else np.inf
        if gained <= 0:
            break
        best = Clusters(moved, pairs, list(kept))
        if gained < least_gain * pairs.sum():
            break
    return best


def classes_for(types: int) -> int:
    return min(max(math.isqrt(types), LEAST_CLASSES), MOST_CLASSES)


def lm_scores(docs: DataFrame, classes: int | None = None, rounds: int | None = None, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Base-10 log probability of each document under classes learnt from those that aren't held out.

    classes is by the vocabulary (classes_for) unless given; cluster() says what ends the rounds.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score, perplexity.
    """
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    made = blocks.build(docs, words(text_or_empty()), marked=split != 2, lower=True)
    vocabulary = _vocabulary(made, classes or MOST_CLASSES)
    sums = vocabulary.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_types"), F.lit(0)).alias("types")).first()
    texts = made.rows.select(F.coalesce(F.sum(F.size(F.filter("marked", lambda x: x))), F.lit(0)).alias("n")).first()["n"]
    totals = Totals(sums["tokens"] + texts, sums["types"] + int(texts > 0), texts)
    classes = classes or classes_for(totals.types)
    found = cluster(made, vocabulary, classes, rounds, least_gain)
    scored = _scores(made, found.moved, totals, found.pairs, _class_sums(found.moved, "types", classes), _class_sums(found.moved, "once", classes), docs.schema["doc_id"].dataType.simpleString())
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
