"""Toxicity by a classifier chain.

Categories are predicted in order. The model of each category is linear (logistic) over text features and the
log-odds of all earlier categories; while training, those are out-of-fold predictions, so a later model learns how far
the earlier ones can be trusted on texts they haven't seen. A document is rejected where the last category's log-odds
reach the cut that has the best F1 on the out-of-fold predictions.

Features are the distinct lower-case words of a text (runs of letters) and their first four, five and six letters, each
counted once per distinct word, under their full 64-bit hashes. Spark counts them over the training rows, by class and
fold, and keeps for each model those that differ between the classes by a chi-square test, MOST_FEATURES at most. Only
these reach the fits, one task per model, which hold at most SAMPLE_ROWS rows of at most MOST_FEATURES numbers, however
long the texts are. Training takes the SAMPLE_ROWS labelled documents with the least hash of their id; every document is
scored whole.

- null and empty texts have no features: they get the models' intercepts;
- a label that is null counts for no category; of several labels of a document the greatest value counts, and of several
  texts of a doc_id the least one is trained on; labels without a document take up no place in the sample;
- a category without both classes among the training rows gets a constant probability; without both in the last category
  documents are rejected from a probability of one half;
- repeated rows are scored each; unlabelled tables give constant probabilities; an empty table gives an empty result;
- columns besides doc_id, text, and those of the labels, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shareflow.llm.common import shuffle_partitions, text_or_empty, written

SAMPLE_ROWS = 10_000
FOLDS = 3
PREFIXES = (4, 5, 6)
#: Least chi-square (one degree of freedom) of a feature that a model keeps, and in how many rows it must occur.
LEAST_CHI2, LEAST_ROWS = 12.0, 3
#: Features of one model at most, those of the greatest chi-square.
MOST_FEATURES = 2000
PENALTY = 1.0
STEPS = 150
#: Words that a task looks at in one go, whatever the size of an Arrow batch; a longer document is looked at alone.
PIECE_WORDS = 500_000
#: Log-odds are kept within this distance of 0.
MOST_ODDS = 10.0

#: Categories in chain order: name, and the condition on the labels for it to hold.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


class Model(NamedTuple):
    """Weights of sorted feature hashes, of the earlier categories' log-odds, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    intercept: float

    def of_features(self, features: np.ndarray) -> np.ndarray:
        at, known = places(self.features, features)
        return np.where(known, self.weights[at], 0.0) if len(self.features) else np.zeros(len(features))


class Chain(NamedTuple):
    """The models in chain order, and the log-odds of the last category from which on a document is rejected."""

    models: list[Model]
    cut: float


def places(kept: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each feature its place in the sorted array `kept`, and whether it is there."""
    if not len(kept):
        return np.zeros(len(features), np.int64), np.zeros(len(features), bool)
    at = np.minimum(np.searchsorted(kept, features), len(kept) - 1)
    return at, kept[at] == features


def tokens() -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty()), r"[^\p{L}]+"), "")


def word_features(words: pa.Array) -> list[np.ndarray]:
    """For each kind of feature the hash of every word; 0 where a word has none of that kind."""

    def hashed(values: pa.Array, kind: int) -> np.ndarray:
        h = pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False)
        return (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)

    if not len(words):
        return [np.empty(0, np.uint64)] * (1 + len(PREFIXES))
    length = np.asarray(pc.utf8_length(words))
    with np.errstate(over="ignore"):
        return [hashed(words, 0)] + [np.where(length >= n, hashed(pc.utf8_slice_codeunits(words, 0, n), n), np.uint64(0)) for n in PREFIXES]


def distinct_words(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The batch's distinct words, and (document, word) once for each word that a document has."""
    found = lists.flatten().dictionary_encode()
    n = max(1, len(found.dictionary))
    doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    pairs = np.unique(doc.astype(np.int64) * n + np.asarray(found.indices))
    return found.dictionary, pairs // n, pairs % n


def pieces(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Runs of lists that hold PIECE_WORDS words at most, or one list."""
    size, begin = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64), 0
    ends = np.cumsum(size)
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - size[begin] + PIECE_WORDS, side="right")))
        yield lists.slice(begin, end - begin)
        begin = end


def _lists(row: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """The values of each of n rows, given in order of row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)), pa.array(values))


def _featured(lists: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Each text's features (as signed integers) in ascending order of their hashes, and how many of its words have each."""
    words, doc, word = distinct_words(lists)
    row = np.tile(doc, 1 + len(PREFIXES))
    feature = np.concatenate([f[word] for f in word_features(words)])
    row, feature = row[feature != 0], feature[feature != 0]
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    counts = np.diff(np.append(np.flatnonzero(first), len(row)))
    row = row[first]
    return _lists(row, len(lists), feature[first].view(np.int64)), _lists(row, len(lists), counts.astype(np.int32))


def _sample(docs: DataFrame, labels: DataFrame, categories) -> DataFrame:
    """id, fold, y (a number per category, null where unknown), features and counts of the training rows, written."""
    flags = [F.max(F.expr(f"cast(({condition}) as double)")).alias(f"y{k}") for k, (_, condition) in enumerate(categories)]
    labelled = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*flags)
    drawn = labelled.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # SAMPLE_ROWS rows of a few numbers at most
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(f"y{k}").alias(f"y{k}") for k in range(len(categories))))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = texts.select(F.col("doc_id").alias("id"), fold.alias("fold"), F.array(*(f"y{k}" for k in range(len(categories)))).alias("y"), tokens().alias("tokens"))
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "id")  # so few rows would else meet in one task

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for piece in pieces(batch.column("tokens")):
                part = batch.slice(begin, len(piece))
                begin += len(piece)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *_featured(piece)], ["id", "fold", "y", "features", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(one, f"id {kind}, fold int, y array<double>, features array<long>, counts array<int>"), "toxicity-sample")


def _selected(sample: DataFrame, n_categories: int) -> dict[tuple[int, int], np.ndarray]:
    """For each model (category, fold left out or FOLDS) the sorted hashes of the features it keeps."""
    y = lambda k: F.col("y")[k]
    cells = [(k, f) for k in range(n_categories) for f in range(FOLDS)]
    sums = [F.coalesce(F.sum(F.when(F.col("fold") == f, x)), F.lit(0.0)).alias(f"{name}_{k}_{f}") for k, f in cells for name, x in (("n", F.when(y(k).isNotNull(), 1.0)), ("pos", y(k)))]
    total = sample.agg(*sums).first()
    counted = sample.select("fold", "y", F.explode("features").alias("feature")).groupBy("feature").agg(*sums).filter(" + ".join(f"n_{k}_{f}" for k, f in cells) + f" >= {LEAST_ROWS}")
    models = []
    for k in range(n_categories):
        for left_out in range(FOLDS + 1):
            used = [f for f in range(FOLDS) if f != left_out]
            n, pos = (sum(total[f"{name}_{k}_{f}"] for f in used) for name in ("n", "pos"))
            if not 0 < pos < n:
                continue
            has, hit = (sum((F.col(f"{name}_{k}_{f}") for f in used), F.lit(0.0)) for name in ("n", "pos"))
            expected = has * (pos / n)
            spread = expected * (1 - pos / n) * (1 - has / (n + 1)) + 1e-9
            models.append(F.struct(F.lit(k).alias("k"), F.lit(left_out).alias("left_out"), F.when(has >= LEAST_ROWS, (hit - expected) ** 2 / spread).alias("chi2")))
    if not models:
        return {}
    best = Window.partitionBy("k", "left_out").orderBy(F.desc("chi2"), "feature")
    scored = counted.select("feature", F.explode(F.array(*models)).alias("m")).select("feature", "m.*").filter(F.col("chi2") >= LEAST_CHI2)
    # MOST_FEATURES rows a model at most
    kept = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= MOST_FEATURES).select("k", "left_out", "feature").collect()
    out: dict[tuple[int, int], list[int]] = {}
    for r in kept:
        out.setdefault((r["k"], r["left_out"]), []).append(r["feature"])
    return {m: np.sort(np.array(x, np.int64).view(np.uint64)) for m, x in out.items()}


def fit(x: np.ndarray, chain: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features and of the chain, and the intercept: penalised logistic regression by accelerated gradient steps.

    x: how many words of each row have each feature.
    """
    n, pos = rows.sum(), y[rows].sum()
    prior = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not pos or pos == n:
        return np.zeros(x.shape[1]), np.zeros(chain.shape[1]), prior
    z = np.column_stack([chain / 4, np.ones(len(x))])  # log-odds on the scale of a feature
    on = rows.astype(float)
    apply = lambda w, v: x @ w.astype(x.dtype) + z @ v
    w, v = np.ones(x.shape[1]), np.ones(z.shape[1])
    for _ in range(12):  # the largest curvature, for the step
        g = on * apply(w, v)
        w, v = g.astype(x.dtype) @ x, z.T @ g
        size = np.sqrt(w @ w + v @ v)
        w, v = w / size, v / size
    step = 1 / (0.25 * 1.1 * size + PENALTY)
    w, v = np.zeros(x.shape[1]), np.append(np.zeros(chain.shape[1]), prior)
    aw, av = w, v
    for k in range(STEPS):
        g = on * (1 / (1 + np.exp(-np.clip(apply(aw, av), -30, 30))) - y)
        nw = (aw - step * (g.astype(x.dtype) @ x)) / (1 + step * PENALTY)
        nv = av - step * (z.T @ g)
        nv[:-1] /= 1 + step * PENALTY
        aw, av = nw + k / (k + 3) * (nw - w), nv + k / (k + 3) * (nv - v)
        w, v = nw, nv
    return w, v[:-1] / 4, float(v[-1])


def _fitted(sample: DataFrame, category: int, kept: dict[tuple[int, int], np.ndarray], earlier: list[DataFrame]) -> DataFrame:
    """Fit the models of one category, each in a task of its own.

    A row per model (left_out, weights, chain, intercept; id null) and per training row (id, its out-of-fold log-odds).
    """
    n_earlier = len(earlier)
    known = sample.select("id", "fold", F.col("y")[category].alias("y"), "features", "counts")
    for k, odds in enumerate(earlier):
        # a row per training row: SAMPLE_ROWS at most
        known = known.join(F.broadcast(odds.select("id", F.col("odds").alias(f"odds{k}"))), "id")
    known = known.select("id", "fold", "y", F.array(*(f"odds{k}" for k in range(n_earlier))).cast("array<double>").alias("chain"), "features", "counts")
    kept_here = [kept.get((category, f), np.empty(0, np.uint64)) for f in range(FOLDS + 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            features, counts = np.asarray(lists.flatten()).view(np.uint64), np.asarray(batch.column("counts").flatten())
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            for left_out, features_kept in enumerate(kept_here):
                at, there = places(features_kept, features)
                cells = [_lists(row[there], len(lists), x[there].astype(np.int32)) for x in (at, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), left_out, np.int32)), *batch.columns[:4], *cells], ["left_out", "id", "fold", "y", "chain", "cols", "counts"])

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        left_out, n = rows["left_out"][0].as_py(), rows.num_rows
        lists = rows["cols"].chunk(0)
        x = np.zeros((n, len(kept_here[left_out])), np.float32)  # SAMPLE_ROWS x MOST_FEATURES at most
        x[np.repeat(np.arange(n), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())] = np.asarray(rows["counts"].chunk(0).flatten())
        chain = np.asarray(rows["chain"].chunk(0).flatten()).reshape(n, -1) if n_earlier else np.zeros((n, 0))
        y = np.asarray(rows["y"].chunk(0).fill_null(np.nan))
        held = np.asarray(rows["fold"].chunk(0)) == left_out
        w, v, intercept = fit(x, chain, np.nan_to_num(y), ~np.isnan(y) & ~held)
        odds = np.clip(x @ w + chain @ v + intercept, -MOST_ODDS, MOST_ODDS)[held]
        m = len(odds)
        return pa.table(
            {
                "left_out": pa.array([left_out] * (m + 1), pa.int32()),
                "id": pa.concat_arrays([pa.nulls(1, rows.schema.field("id").type), rows["id"].chunk(0).filter(pa.array(held))]),
                "y": pa.concat_arrays([pa.nulls(1, pa.float64()), rows["y"].chunk(0).filter(pa.array(held))]),
                "odds": pa.concat_arrays([pa.nulls(1, pa.float64()), pa.array(odds)]),
                "weights": pa.array([w.tolist()] + [None] * m, pa.list_(pa.float64())),
                "chain": pa.array([v.tolist()] + [None] * m, pa.list_(pa.float64())),
                "intercept": pa.array([intercept] + [None] * m, pa.float64()),
            }
        )

    kind = sample.schema["id"].dataType.simpleString()
    dealt = known.mapInArrow(deal, f"left_out int, id {kind}, fold int, y double, chain array<double>, cols array<int>, counts array<int>")
    dealt = dealt.repartitionByRange(FOLDS + 1, "left_out")  # so small a table would else meet in one task
    return written(dealt.groupBy("left_out").applyInArrow(one, f"left_out int, id {kind}, y double, odds double, weights array<double>, chain array<double>, intercept double"), "toxicity-models")


def best_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """The log-odds from which on to reject for the best F1, half way to the next lower prediction; 0 without both classes."""
    pos = y.sum()
    if not 0 < pos < len(y):
        return 0.0
    order = np.argsort(-odds, kind="stable")
    odds, hits = odds[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(odds) + 1) + pos)
    f1[:-1][odds[1:] == odds[:-1]] = -1  # no cut between equal predictions
    best = int(np.argmax(f1))
    return float((odds[best] + odds[min(best + 1, len(odds) - 1)]) / 2)


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> Chain:
    """Fit the chain on a bounded sample of labelled documents and bring the models, which MOST_FEATURES bounds, to the driver."""
    sample = _sample(docs, labels, categories)
    kept = _selected(sample, len(categories))
    models: list[Model] = []
    odds: list[DataFrame] = []
    for k in range(len(categories)):
        fitted = _fitted(sample, k, kept, odds)
        full = fitted.filter((F.col("left_out") == FOLDS) & F.col("id").isNull()).first()
        features = kept.get((k, FOLDS), np.empty(0, np.uint64))
        models.append(Model(features, np.array(full["weights"]), np.array(full["chain"]), full["intercept"]) if full else Model(features, np.empty(0), np.zeros(k), 0.0))
        odds.append(fitted.filter("id is not null").select("id", "y", "odds"))
    last = odds[-1].filter("y is not null").select("odds", "y").collect()  # SAMPLE_ROWS rows at most
    return Chain(models, best_cut(np.array([r["odds"] for r in last]), np.array([r["y"] for r in last])))


def score(docs: DataFrame, chain: Chain, categories=CATEGORIES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, p_<category> for each category and `rejected`: the last category's log-odds reach the cut."""
    shared = docs.sparkSession.sparkContext.broadcast(chain.models)
    names = [f"p_{name}" for name, _ in categories]

    def odds(lists: pa.ListArray) -> np.ndarray:
        words, doc, word = distinct_words(lists)
        features = word_features(words)
        found = np.zeros((len(lists), 0))
        for model in shared.value:
            of_word = sum(np.where(f != 0, model.of_features(f), 0.0) for f in features)
            one = np.bincount(doc, of_word[word], minlength=len(lists)) + found @ model.chain + model.intercept
            found = np.column_stack([found, np.clip(one, -MOST_ODDS, MOST_ODDS)])
        return found

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([odds(x) for x in pieces(batch.column(batch.num_columns - 1))] or [np.zeros((0, len(names)))])
            p = 1 / (1 + np.exp(-found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(p[:, k]) for k in range(len(names)))], [*batch.schema.names[:-1], *names])
            del batch
            pa.default_memory_pool().release_unused()

    kept = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} double" for n in names])
    return docs.select(*keep, tokens().alias("words of the text")).mapInArrow(one, schema).withColumn("rejected", F.col(names[-1]) >= float(1 / (1 + np.exp(-chain.cut))))
