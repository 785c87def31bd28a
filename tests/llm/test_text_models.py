import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pyspark.sql import functions as F

from shareflow.llm import blocks, bpe, chat, lm, ngram_join, topk, toxicity
from shareflow.llm.common import text_or_empty, words

WORD = r"[^\x20\x09-\x0D]+"
EXTRA = ", mark long, ids string, bucket int, tokens string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], "doc_id long, text string" + EXTRA)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_packing():
    import numpy as np
    import pyarrow as pa

    for values in ([], [0], [1, 255], [70000, 3], [2**40, 1]):
        assert blocks.unpack_ints(blocks.pack_ints(np.array(values, np.int64))).tolist() == values
    for words in ([], ["", "a\0b", "é" * 9]):
        assert blocks.unpack_strings(blocks.pack_strings(pa.array(words, pa.string()))).to_pylist() == words
    assert blocks.unpack_strings(blocks.pack_strings(pa.array(["no", "a", "b"]).slice(1))).to_pylist() == ["a", "b"]


def test_bpe_round_trip(spark, ranks, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 50)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "  two  spaces\n\n 's don't 12,345 <|endoftext|>", "été ñandú 股份 🎉 " * 40, "a" * 200_000, "　 x", "same", "same"]
    rows = list(enumerate(texts)) + [(None, "no id"), (7, "same")]
    df = docs(spark, rows)
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(df, ranks, public_tokenizers.PATTERN).collect())
    assert got == Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)
    back = Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    assert bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(nulls, ranks).collect()} == {1: None, 2: b""}


def test_lm_beats_unigrams_on_held_out_text(spark):
    rng = random.Random(3)
    vocabulary = {lang: [f"{lang}{k}" for k in range(150)] for lang in "ab"}
    rows = [(k, " ".join(f"{rng.choice(vocabulary['ab'[k % 2]])}" if j % 2 else f"the{'ab'[k % 2]}" for j in range(60))) for k in range(300)]
    rows += [(None, None), (1000, ""), (1001, "Never SEEN words"), (5, rows[5][1])]
    got = {(r.doc_id, r.n_tokens): r for r in lm.lm_scores(docs(spark, rows), classes=8, rounds=3).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = {k: re.findall(WORD, (t or "").lower()) + [None] for k, (_, t) in enumerate(rows)}
    count = Counter(w for k, ws in words.items() if not held(rows[k][0]) for w in ws)
    n, v = sum(count.values()), len(count)
    for k, (i, _) in enumerate(rows):
        r = got[i, len(words[k])]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[k])
        assert r.held_out == held(i) and r.train_tokens == n and r.n_known == sum(w in count for w in words[k])
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and r.score < 0
    held_rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
    assert lm.lm_scores(docs(spark, [])).count() == 0


def test_class_model_is_a_distribution(spark):
    rows = [(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 7 != 2]
    tests = ["a", "b", "new"]
    held = [k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = {r.doc_id: r for r in lm.lm_scores(docs(spark, rows + list(zip(held, tests, strict=True))), classes=4, rounds=2).collect()}
    # one-word texts, one of them for all unseen words, leave room for the empty text and for longer ones
    assert sum(10 ** got[i].score for i in held) < 1


def test_class_model_scores_follow_from_its_classes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 60)
    rng = random.Random(11)
    halves = [[f"{c}{k}" for k in range(8)] for c in "ab"]
    rows = [(k, " ".join(rng.choice(halves[j % 2]) for j in range(rng.randrange(0, 12)))) for k in range(60)] + [(60, "new a1 newer"), (61, None)]
    df, classes = docs(spark, rows), 5
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    split = F.crc32(F.col("doc_id").cast("string")) % 7
    made = blocks.build(df, words(text_or_empty()), marked=split != 2, lower=True)
    found = lm.cluster(made, lm._vocabulary(made), classes, 4)
    assert all(x < y for x, y in zip(found.likelihoods, found.likelihoods[1:], strict=False))
    of_word = {}
    for r in made.words.join(found.moved.filter("kind = 'answers'").select("block", "bucket", "classes"), ["block", "bucket"]).collect():
        of_word |= dict(zip(blocks.unpack_strings(r["words"]).to_pylist(), blocks.unpack_ints(r["classes"]).tolist(), strict=True))
    texts = {i: (t or "").split() for i, t in rows}
    n = Counter(w for i, t in texts.items() if train(i) for w in t)
    pairs = np.zeros((classes + 1, classes + 1))
    for i, t in texts.items():
        path = [classes, *(of_word[w] for w in t), classes]
        for x, y in zip(path, path[1:], strict=False):
            pairs[x, y] += train(i)
    assert (pairs == found.pairs).all() and abs(lm.likelihood(pairs) - found.likelihoods[-1]) < 1e-6
    known = (pairs + 1) / (pairs.sum(1, keepdims=True) + classes + 1)
    once, types, total = (np.array([f(k) for k in range(classes)], float) for f in (lambda k: sum(c == 1 and of_word[w] == k for w, c in n.items()), lambda k: sum(of_word[w] == k for w in n), lambda k: sum(c for w, c in n.items() if of_word[w] == k)))
    after_new = (once + 1) / (once + 1).sum() @ known[:classes]
    got = {r.doc_id: r for r in lm.lm_scores(df, classes, len(found.likelihoods)).collect()}
    for i, t in texts.items():
        want, before = 0.0, known[classes]
        for w in t:
            k = of_word[w]
            want += math.log10(before[k] * (n[w] + 1) / (total[k] + types[k] + 1) if w in n else (before[:classes] / (total + types + 1)).sum())
            before = known[k] if w in n else after_new
        assert abs(got[i].score - want - math.log10(before[classes])) < 1e-9


def jaccard_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if i is not None or g in least else None
    return Counter((i, len(s), least[g]) for g, s, (i, _) in zip(group, sets, rows, strict=True))


def near_copies(rng, n_groups, size, words):
    rows = []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("first, growth, part", [(8, 8, 4096), (1, 2, 3), (100, 8, 5)])
def test_ngram_join_against_all_pairs(spark, monkeypatch, first, growth, part):
    monkeypatch.setattr(ngram_join, "FIRST_TURN", first)
    monkeypatch.setattr(ngram_join, "GROWTH", growth)
    monkeypatch.setattr(ngram_join, "PART_ROWS", part)
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 900)
    rows = near_copies(random.Random(4), 4, 14, 70)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b c"), (904, "A  b C"), (905, "a b c d"), (906, "x " * 500), (907, "x " * 501), (3, rows[3][1]), (3, rows[3][1])]
    got = Counter(map(tuple, ngram_join.ngram_join(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == jaccard_components(rows)


def test_digests_against_tiktoken(spark, ranks, monkeypatch):
    import hashlib

    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 40)
    said = ["Hello, world!  12345 ünïcödé 🎉\r\n tabs\t", "", None, "<|endoftext|> x", "a" * 3000, "Hello, world!"]
    engine = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(docs(spark, list(enumerate(said))), ranks, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(said):
        ids = engine.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids) and got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_ngram_join_empty_and_null_ids(spark):
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0
    got = Counter(map(tuple, ngram_join.ngram_join(docs(spark, [(None, "a b c d e"), (4, "a b c d e"), (None, None)])).collect()))
    assert got == Counter({(None, 1, 4): 1, (4, 1, 4): 1, (None, 0, None): 1})


@pytest.mark.parametrize("partitions", [1, 4, 211])
def test_top_k_against_brute_force(spark, monkeypatch, partitions):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "SLAB_QUERIES", 3)
    monkeypatch.setattr(topk, "SLAB_SHARDS", 2)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    rows = [(k, [round(rng.uniform(-1, 1), 1) for _ in range(4)]) for k in range(150)] + [(20, [0.5, 0.5, 0.5, 0.5]), (160, [1.0]), (161, None), (162, []), (163, [1.0, None, 0.0, 0.0]), (164, [float("nan")] * 4), (165, [float("inf")] * 4), (None, [1.0] * 4), (170, [3.0e6] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, shard int").repartition(partitions)
    vectors = topk.quantised(df)
    queries = vectors.filter("vec_id % 20 = 0 and size(v) = 4 and vec_id <> 20")
    got = {}
    for r in topk.top_k(queries, vectors, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, [math.floor(1024 * np.float32(x).item()) for x in v]) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in ok:
        if i % 20 == 0 and i != 20:
            best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i))[:5]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    if partitions == 1:
        assert topk.top_k(queries, vectors.limit(0), 5).count() == 0 and topk.top_k(queries.limit(0), vectors, 5).count() == 0


def test_top_k_prunes_shards_and_keeps_large_products_exact(spark):
    rows = [(k, [k // 10 * 1000 + k % 10, 1]) for k in range(40)] + [(99, [2**40, 3]), (98, [2**40 - 1, 5])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").coalesce(1)
    got = [tuple(r) for r in topk.top_k(vectors.filter("vec_id = 39"), vectors, 2).orderBy("rank").collect()]
    assert got == [(39, 1, 99, 3009 * 2**40 + 3), (39, 2, 98, 3009 * (2**40 - 1) + 5)]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(vectors.filter("vec_id = 99"), vectors, 2).collect()


def test_top_k_searches_few_shards_of_clustered_vectors(spark, monkeypatch):
    """40 tight clusters in random order: at most a fifth of the pairs of query and shard are searched, and results are exact."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 128)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 16)) * 1000
    v = (middle[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 5).astype(np.int64)
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<long>")
    reached = []
    kept = topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: reached.append((name, kept(df, name))) or reached[-1][1])
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10).collect()}
    table = dict(reached)
    pairs = table["topk-extremes"].count() * table["topk-queries"].count()
    assert table["topk-reached"].count() + table["topk-best"].count() <= pairs / 5
    for q in range(0, 6000, 100):
        scores = v @ v[q]
        best = sorted((j for j in range(6000) if j != q), key=lambda j: (-scores[j], j))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(j, scores[j]) for j in best]


def test_chat_spans_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 3)
    said = ["hi", "</s>[INST] ok [/INST]", "\\", "<|end|>\n", "a\n<|turn|>user\nb<|end|>\n", "", None, "<\\/s>", "é🎉"]
    turns = [(1, k, "assistant" if k % 2 else "user", said[k]) for k in range(len(said))] + [(2, 0, None, "x"), (2, 1, "odd\nrole\\", "y"), (None, None, "assistant", "z"), (3, 0, "user", "p"), (3, 0, "user", "p")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    segments = chat.format_segments(df)
    assert segments.filter("conv_id = 1").count() == 3
    import hashlib

    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    for conv in (1, 2, 3, None):
        own = [("user" if r is None else r, t or "") for c, _, r, t in turns if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_segments(df.limit(0))).count() == 0


def test_templates_that_rewrite_history():
    def last_only(turns):  # keeps reasoning in the last turn only
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t.replace('<think>', '')}" for k, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "<think>b"), ("user", "c")]
    whole, spans, rewritten = chat.turn_spans(turns, last_only)
    assert rewritten == 2 and spans == [(0, 7), None, None] and whole == last_only(turns)
    whole, spans, rewritten = chat.turn_spans(turns, chat.turn_template)
    assert rewritten is None and [chat.read_turn(whole[s:e])[:2] for s, e in spans] == turns


def test_toxicity_chain_on_held_out_text(spark):
    rng = random.Random(6)
    plain = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["vileaa", "vilebb", "vilecc", "vile" + rng.choice("defgh")])
        if low := k % 7 == 1:
            words[:20] = ["junk"] * 20
        rows.append((k, " ".join(words)))
        if k < 400:
            labels.append((k, 0 if low else 1, int(toxic)))
    labels += [(9999, 1, 1), (None, 1, 1), (0, None, None)]
    df = docs(spark, [*rows, (700, None), (701, ""), (None, rows[0][1])])
    label_frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, label_frame)
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    assert len(got) == 603
    fresh = [got[k].rejected == (k % 5 == 0) for k in range(400, 600)]
    assert sum(fresh) >= 196 and not got[700].rejected and not got[701].rejected and got[None].rejected
    assert sum((got[k].p_low_quality > 0.5) == (k % 7 == 1) for k in range(400, 600)) >= 190
    assert len(chain.models[1].chain) == 1
    nothing = toxicity.train(df, label_frame.limit(0))
    assert toxicity.score(df.limit(0), nothing).count() == 0 and len({r.p_toxic for r in toxicity.score(df, nothing).collect()}) == 1


def test_toxicity_fit_against_newtons_method():
    rng = np.random.default_rng(1)
    dense, chain = rng.poisson(0.3, (80, 12)).astype(float), rng.normal(size=(80, 1))
    y = (dense[:, 0] + chain[:, 0] > 0.5).astype(float)
    rows = rng.random(80) < 0.8
    w, v, intercept = toxicity.fit(dense.astype(np.float32), chain, y, rows)
    x, t = np.column_stack([dense, chain / 4, np.ones(80)])[rows], y[rows]
    penalty, b = np.diag([toxicity.PENALTY] * 13 + [0.0]), np.zeros(14)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - t) + penalty @ b)
    assert np.allclose([*w, *(v * 4), intercept], b, atol=0.02)


def test_toxicity_selection_against_counts(spark):
    rng = random.Random(8)
    words = [chr(97 + k) * 3 for k in range(12)]
    texts = [(k, " ".join(rng.sample(words[:6] if k % 2 else words[3:], 4))) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    sample = toxicity._sample(docs(spark, [*texts, (0, "~later")]), labels, toxicity.CATEGORIES)
    kept = toxicity._selected(sample, 2)
    assert sample.count() == 60 and all(k == 1 for k, _ in kept)
    fold = {r.id: r.fold for r in sample.collect()}
    for left_out in range(toxicity.FOLDS + 1):
        rows = [(set(t.split()), k % 2) for k, t in texts if fold[k] != left_out]
        n, pos, want = len(rows), sum(y for _, y in rows), []
        for w in words:
            has, hit = sum(w in t for t, _ in rows), sum(y for t, y in rows if w in t)
            chi2 = (hit - has * pos / n) ** 2 / (has * pos / n * (1 - pos / n) * (1 - has / (n + 1)) + 1e-9) if has else 0
            if has >= toxicity.LEAST_ROWS and chi2 >= toxicity.LEAST_CHI2:
                want.append(w)
        import pyarrow as pa

        hashes = toxicity.word_features(pa.array(want))[0] if want else []
        assert sorted(hashes) == list(kept.get((1, left_out), []))


def test_cut_of_best_f1():
    assert toxicity.best_cut(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1.0, 1.0, 0.0, 0.0])) == 0.5
    assert toxicity.best_cut(np.array([1.0, 1.0, 0.0]), np.array([1.0, 0.0, 0.0])) == 0.5
    assert toxicity.best_cut(np.array([]), np.array([])) == 0.0 and toxicity.best_cut(np.array([1.0]), np.array([1.0])) == 0.0


def test_classes_by_vocabulary():
    assert [lm.classes_for(n) for n in (0, 10, 2500, 10**7)] == [lm.LEAST_CLASSES, lm.LEAST_CLASSES, 50, lm.MOST_CLASSES]


@pytest.mark.parametrize("words_with_neighbours", [0, 300])
def test_best_class_of_each_word_by_brute_force(words_with_neighbours):
    rng, classes, n = np.random.default_rng(0), 6, 400
    weights, price = rng.normal(size=(14, classes)), rng.normal(size=classes)
    # squares make some words frequent, with neighbours of most classes, and many rare; cells repeat
    word = (rng.random(3000) ** 4 * words_with_neighbours).astype(np.int64)
    cells, seen = word * 14 + rng.integers(0, 14, 3000), rng.integers(1, 9, 3000)
    if not words_with_neighbours:
        cells, seen = cells[:0], seen[:0]
    counts = np.bincount(cells // 14, minlength=n)
    dense = np.zeros(n * 14)
    np.add.at(dense, cells, seen)
    wanted = np.where(counts > 0, (dense.reshape(n, 14) @ weights - counts[:, None] * price).argmax(axis=1), 0)
    assert (lm._best(cells, seen, weights, counts, price) == wanted).all()
