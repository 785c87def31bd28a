import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shareflow.llm import cross_tokens, line_dedup, merkle
from shareflow.llm.queries import QUERIES, vocabularies
from tests.oracle import HAVE_DATA, SF_DIR

#: Documents with extra columns whose names the operators use themselves.
DDL = "doc_id long, text string, lang string, source string, n_chars long, digest string, lo int, line_hash int, block int, pair int, `group` string, path int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, n, "d", 1, 2, 3, 4, "g", 5) for i, t, la, s, n in rows], DDL)


def texts(spark, rows):
    return docs(spark, [(i, t, "en", "s", 1) for i, t in rows])


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climbed(nodes):
    """The root over nodes, and for each of them the siblings left and right, level by level."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(place):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append((run[: i % 16], run[i % 16 + 1 :]))
        place = [i // 16 for i in place]
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def manifest_by_hand(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = ordered, *climbed([leaf_of(r) for r in ordered])
    root, upper = climbed([trees[s][1] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        ordered, subroot, paths = trees[s]
        for r, below in zip(ordered, paths, strict=True):
            lowered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf_of((r[0], "".join(c.lower() if c < "\x80" else c for c in r[1]), *r[2:]) if lowered else r)
            for left, right in below + above:
                fold = sha("".join([*left, fold, *right]))
            out.append((r[0], leaf_of(r), subroot, root, sha("".join(x for left, right in below + above for x in left + right)), fold, fold == root))
    return Counter(out)


def rows_of_sources(sizes, seed=1):
    rng = random.Random(seed)
    out = [(k, f"Text {k} É", "en", s, k) for s, n in sizes.items() for k in rng.sample(range(10**6), n)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(
    "rows",
    [
        rows_of_sources({"a": 300, "b": 17, "é": 16, "": 1, None: 33}),
        rows_of_sources({f"s{k}": 1 + k % 3 for k in range(40)}),
        rows_of_sources({"only": 257}),
        [(7, "One", "en", "s", 3)],
        [(7, "A", None, "s", None), (7, "A", None, "s", None), (7, "B", "en", None, 1), (None, None, None, None, None), (None, "x" * 200_000, "en", None, 3), (3, "", "", "", 0)] * 9,
    ],
)
def test_manifest(spark, rows):
    got = merkle.verified(docs(spark, rows), {"text": merkle.lower_cased()})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == manifest_by_hand(rows)


def test_manifest_of_nothing_and_with_a_false_claim(spark):
    df = docs(spark, rows_of_sources({"a": 40, "b": 2}))
    assert merkle.verified(df.limit(0), {}).count() == 0
    assert merkle.verified(df, {}).filter("not verified").count() == 0
    lied = merkle.verified(df, {"n_chars": F.when(F.col("n_chars") % 2 == 0, -1).otherwise(F.col("n_chars"))})
    assert lied.filter("not verified").count() == df.filter("n_chars % 2 = 0").count()


def test_numbers_of_a_hot_group(spark):
    """Equal items share no range's fate: every number is given once."""
    items = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("group"), F.lit(5).alias("k"))
    items.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/items-of-test")
    got = merkle.numbered(spark.read.parquet(path), ["k"]).groupBy("group").agg(F.count_distinct("lo").alias("n"), F.max("lo").alias("top"), F.max("leaves").alias("leaves")).collect()
    assert all(r.n == r.leaves == r.top + 1 for r in got) and sum(r.n for r in got) == 3000


# lines


def lines_by_hand(rows, least_chars=40, least_documents=5):
    low = lambda t: "".join(c.lower() if c < "\x80" else c for c in t.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(low(line)) >= least_chars:
                holders[low(line)].add(i)
    keeper = {k: max(x for x in ids if x is not None) for k, ids in holders.items() if len(ids) >= least_documents}
    out = []
    for i, t in rows:
        found = (t or "").split("\n")
        stay = [x for x in found if keeper.get(low(x), i) == i]
        out.append((i, len(found), len(found) - len(stay), "\n".join(stay)))
    return Counter(out)


LONG = "This line of boilerplate is long enough to be looked at"


def test_lines(spark):
    rng = random.Random(2)
    pool = [f"{LONG} number {k}" for k in range(6)] + ["short", "", "  ", f" \t{LONG} NUMBER 1\v\f", "é" * 40, "é" * 39, "\x85" + "x" * 39]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for k in range(60)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (5, f"other\n{pool[0]}"), (None, f"{pool[0]}\n{pool[0]}"), (None, None), (None, f"a\n{pool[1]}"), (70, None), (71, ""), (72, "\n"), (73, "\n\n" + pool[2] + "\n\n")]
    # a very long text of repeated and of different lines, held by the greatest id and by others
    rows += [(99, "\n".join([pool[0]] * 5000 + [f"{LONG} only {k}" for k in range(5000)])), (98, "\n".join([pool[0], "x"] * 5000))]
    rng.shuffle(rows)
    got = line_dedup.line_dedup(texts(spark, rows))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert Counter(map(tuple, got.collect())) == lines_by_hand(rows)
    assert line_dedup.line_dedup(texts(spark, rows[:0])).count() == 0
    few = line_dedup.line_dedup(texts(spark, rows), 5, 2)
    assert Counter(map(tuple, few.collect())) == lines_by_hand(rows, 5, 2)


def test_lines_of_four_and_of_five_documents(spark):
    rows = [(k, f"{LONG} five") for k in range(5)] + [(k, f"{LONG} four") for k in range(10, 14)] + [(13, f"{LONG} four")]
    got = {(r.doc_id, r.kept_text) for r in line_dedup.line_dedup(texts(spark, rows)).collect() if r.n_dropped}
    assert got == {(k, "") for k in range(4)}


# alignment


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {chr(b): b for b in OWN} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in OWN)}


def token_bytes_a(token):
    return bytes(LETTERS[c] for c in token)


def token_bytes_b(model, k):
    piece = model.id_to_piece(k)
    return bytes([int(piece[1:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()


def aligned_by_hand(rows, tools):
    """Every document's groups and links from all pairs of tokens of a group, by the libraries of the two vocabularies."""
    a_model, b_model = tools
    found, counts = [], Counter()
    for i, text in rows:
        groups, links = [], []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False)
            a = [(k, token_bytes_a(t)) for k, t in zip(a.ids, a.tokens, strict=True)]
            b = [(k, token_bytes_b(b_model, k)) for k in b_model.encode(text)]
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                spans = []
                for side in (a, b):
                    at, out = 0, []
                    for k, t in side:
                        out.append((k, at, at + len(t)))
                        at += len(t)
                    spans.append(out)
                cut = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                x = y = 0
                for end in cut:
                    x2, y2 = (next(n for n in range(begin, len(side)) if side[n][2] == end) + 1 for begin, side in ((x, spans[0]), (y, spans[1])))
                    groups.append((spans[0][x:x2], spans[1][y:y2]))
                    x, y = x2, y2
                links = [(p[0], q[0]) for left, right in groups for p in left for q in right if p[1] < q[2] and q[1] < p[2]]
        counts.update(links)
        found.append((i, groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, groups, links in found:
        text = ";".join("|".join(",".join(str(k) for k, _, _ in side) for side in g) for g in groups)
        digest = sha(text) if groups else ""
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest, text))
    return Counter(out)


ODD = ["", None, " ", "a", "  two  spaces\n\n\ttab", "▁", "a▁b", "naïve café — “quotes”", "日本語のテキスト、中文字符。", "🙂🙂 👩‍👩‍👧", "<s> </s> <unk> <|endoftext|> <0x41>", "\0\x01", "﻿ﬁ ﬂ", "١٢٣ 123456789", "don't we'll I'm", "\r\n", " 　 ", "é"]


@pytest.mark.parametrize("block_bytes, cuts", [(2 << 20, True), (40, True), (4000, False)])
def test_alignment(spark, tools, monkeypatch, block_bytes, cuts):
    monkeypatch.setattr(cross_tokens, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    words = "the of alignment tokenization vocabularies Überraschung geschwindigkeitsbegrenzung 東京 данные unbelievable aaaa 42".split()
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for k in range(40)]
    rows += [(None, "null id"), (None, "null id"), (1, "again"), (1, "again"), (7, "word " * 20_000), (8, "x" * 50_000), (9, " " * 30_000 + "z")]
    rng.shuffle(rows)
    df = texts(spark, rows)
    got = cross_tokens.align(df, vocabularies()._replace(cut_at_spaces=cuts), with_text=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert Counter(map(tuple, got.collect())) == aligned_by_hand(rows, tools)
    assert cross_tokens.align(df.limit(0), vocabularies()).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="the driver's tables aren't here")
def test_alignment_query_by_hand(spark, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op13_cross_tokens"](spark, SF_DIR).collect())) == Counter({k[:-1]: n for k, n in aligned_by_hand(rows, tools).items()})


def test_a_run_of_spaces_that_the_engine_cannot_cut(tools):
    made = cross_tokens._encoders(vocabularies())
    text = " " + " " * 1_500_000 + "a"
    assert made.encode_a(text) == tools[0].encode(text, add_special_tokens=False).ids
