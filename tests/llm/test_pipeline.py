import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def plain(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def text(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"w{seed}x{rng.randrange(1000)}" for _ in range(n))


def digest(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_row_keys_are_in_order_of_ids(spark):
    ids = [None, -5, 0, 3, 2**40, -(2**63), 2**63 - 1]
    keys = {r.doc_id: r.k for r in frame(spark, [(i, "x", "s") for i in ids]).select("doc_id", pipeline.row_key().alias("k")).collect()}
    assert sorted(ids, key=keys.get) == [*sorted(i for i in ids if i is not None), None]


def test_near_copies_of_null_and_shared_ids(spark):
    near = lambda t: t + " tail"
    a, b, c, d, e = map(text, range(5))
    rows = [(None, a), (5, near(a)), (None, b), (None, near(b)), (None, c), (7, d), (7, e), (6, near(e)), (-2, near(d)), (8, None), (None, ""), (9, " ")]
    got = plain(pipeline.drop_near_copies(spark, frame(spark, [(*r, "s") for r in rows]), ""))
    least = min(b, near(b), key=digest)
    # of a text's component only the smallest id stays, null ids after all others; blank texts have no copies
    assert got == Counter([(5, near(a)), (None, least), (None, c), (6, near(e)), (-2, near(d)), (8, None), (None, ""), (9, " ")])
    assert pipeline.drop_near_copies(spark, frame(spark, []), "").count() == 0


def test_mix_of_null_shared_and_blank_rows(spark):
    # sources a and b weigh 1 and 2, so half of a is left over
    rows = [(None if k % 2 else 3, text(100 + k, 10), "a") for k in range(40)]
    rows += [(None, text(200 + k, 10), "b") for k in range(10)] + [(1, None, "a"), (2, "", "b"), (4, " \n", "b")]
    got = plain(pipeline.mix_sources(spark, frame(spark, rows), ""))
    words = Counter()
    for (_, t), n in got.items():
        words[next(s for _, x, s in rows if x == t)] += n * len(t.split())
    # budget: 500 words by weight, b at most three times its size
    assert words["b"] == 300 and abs(words["a"] - 200) <= 10
    assert all(t and t.split() for _, t in got)
    again = plain(pipeline.mix_sources(spark, frame(spark, rows + rows), ""))
    assert again == got
    assert pipeline.mix_sources(spark, frame(spark, []), "").count() == 0


def test_copies_of_null_and_repeated_rows(spark):
    rows = [(4, "same text"), (2, "same text"), (2, "same text"), (None, "same text"), (None, "other"), (None, "other"), (9, "last")]
    got = plain(pipeline.drop_copies(spark, frame(spark, [(*r, "s") for r in rows]), ""))
    assert got == Counter([(2, "same text"), (None, "other"), (9, "last")])
    assert pipeline.drop_copies(spark, frame(spark, []), "").count() == 0


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows = [(k, text(k) + (" vile viler vilest" if k % 5 == 0 else ""), "ab"[k % 2]) for k in range(200)]
    rows += [(None, text(1), "a"), (None, text(777), "b"), (300, text(3) + " tail", "b"), (301, None, "a"), (302, " ", "b"), rows[1], (3, text(778), "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_toxic_documents_go_and_the_rest_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = plain(pipeline.drop_toxic(spark, docs, sf_dir))
    assert got == Counter({k: n for k, n in plain(docs).items() if "vilest" not in (k[1] or "")})


def test_run_is_its_stages_and_ends_with_ids(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    from shareflow.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path(pipeline.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, sf_dir), "test-pipeline")
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in pipeline.run(spark, sf_dir).collect())
    want = Counter()
    for (i, t), n in plain(docs).items():
        ids = tuple(enc.encode_ordinary(t))
        want[i, len(ids), ids] += n
    assert got == want and got
    texts = {t for _, t in plain(docs)}
    assert not any("vilest" in t for t in texts) and text(3) + " tail" not in texts
