import random
from collections import Counter
from datetime import date

import numpy as np
import pytest

from shareflow.llm import components, exact_dedup, fuse, licenses, mixing, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, block int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, "d", 7, 9) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 5000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    other = np.random.default_rng(99).integers(0, 2**63, 20000).astype(np.uint64)
    filter_bytes = fuse.build(np.concatenate([keys, keys]))
    assert fuse.probe(filter_bytes, keys).all()
    assert fuse.probe(filter_bytes, other).mean() < 0.01


def test_exact_dedup(spark):
    rows = [(5, "a  b\n", "s"), (3, "a b ", "s"), (7, "a b ", None), (1, "c", "s"), (2, None, "s"), (4, "", "s"), (None, "c", "s"), (None, "n", "s"), (9, "x" * 100_000, "s"), (9, "x" * 100_000, "s")]
    df = docs(spark, rows)
    batch, earlier = exact_dedup.split_by_day(df)
    assert batch.count() + earlier.count() == len(rows)
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(batch, earlier).collect())
    assert got == sorted([(5, 3, 3, False), (3, 3, 3, True), (7, 3, 3, False), (1, 1, 2, True), (0, 1, 2, False), (2, 2, 2, True), (4, 2, 2, False), (0, 0, 1, True), (9, 9, 2, True), (9, 9, 2, True)])
    none = df.limit(0)
    assert exact_dedup.exact_dedup(none, none).count() == 0
    # all new against an empty snapshot, all known against itself
    assert {r.in_snapshot for r in exact_dedup.exact_dedup(df, none).collect()} == {False}
    assert {r.in_snapshot for r in exact_dedup.exact_dedup(df, df).collect()} == {True}
    both = exact_dedup.dedup_split(df, exact_dedup.in_new_batch()).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in both) == got


def test_snapshot_is_read_again_and_texts_may_be_shuffled(spark, tmp_path, monkeypatch):
    df = docs(spark, [(k, f"text {k % 7}", "s") for k in range(30)])
    hashed = exact_dedup.digests(df)
    made = exact_dedup.build_snapshot(hashed, f"{tmp_path}/snapshot")
    again = exact_dedup.read_snapshot(spark, f"{tmp_path}/snapshot")
    groups = exact_dedup.grouped(hashed)
    assert again.buckets == made.buckets and exact_dedup.screen(groups, again).count() == 7
    for few in (0, 10):
        monkeypatch.setattr(exact_dedup, "FEW_REPEATED", few)
        assert exact_dedup.same_bytes(df, groups.filter("n_rows > 1")).count() == 7


def test_mixing_cuts_each_source_at_its_budget(spark):
    rng = random.Random(1)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["a"] * 20 + ["b", "c", None])) for k in range(600)] + [(None, "x y", "b"), (0, "w w", "a"), (0, "w w", "a"), (601, None, "d")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r.size and r.source_size >= r.size
    assert all(taken[s] == int(goal[s]) for s in goal)
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-6 and goal["d"] == 0
    # the capped sources stop at three times their size, the rest is shared by weight
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    free = [s for s in goal if goal[s] < 3 * sizes[s] - 1e-6]
    assert max(goal[s] / weight[s] for s in free) - min(goal[s] / weight[s] for s in free) < 1e-6
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_url_filter_as_of(spark):
    entries = [("l", "bad.com", "add", date(2024, 1, 10)), ("l", "bad.com", "remove", date(2024, 2, 1)), ("l", "bad.com", "add", date(2024, 3, 1)), ("l", "bad.com", "add", date(2024, 3, 1)), ("m", "x.org/p", "add", date(2024, 1, 1)), ("m", "y.org", "add", date(2024, 1, 5)), ("m", "y.org", "remove", date(2024, 1, 5)), ("m", None, "add", date(2024, 1, 1)), ("m", "z", "toggle", date(2024, 1, 1))]
    captures = [
        (1, "http://a.bad.com/x", date(2024, 1, 9)), (2, "http://A.BAD.com:80/x", date(2024, 1, 10)), (3, "http://bad.com", date(2024, 2, 1)), (4, "http://u@bad.com./", date(2024, 5, 1)),
        (5, "https://x.org/p/q?r", date(2024, 2, 1)), (6, "https://x.org/P", date(2024, 2, 1)), (7, "http://y.org", date(2024, 1, 6)), (8, None, date(2024, 1, 6)), (9, "junk", date(2024, 1, 6)), (10, "http://bad.com", None), (11, "http://notbad.com/", date(2024, 5, 1)), (2, "http://A.BAD.com:80/x", date(2024, 1, 10)),
    ]
    c = spark.createDataFrame([(*x, "salt") for x in captures], "page_id long, url string, fetched_on date, salt string")
    e = spark.createDataFrame([(*x, "h") for x in entries], "list_name string, pattern string, action string, effective_on date, host string")
    got = {r.page_id: (r.blocked, r.lists) for r in url_filter.url_filter(c, e).collect()}
    assert {k for k, v in got.items() if v[0]} == {2, 4, 5, 7} - {7} and len(got) == 11
    assert got[5] == (True, "m") and got[8] == (False, "")
    # a hot host, hot captures without a host, a very long url, a very long host
    more = [(100 + k, f"http://h{k % 3}.bad.com/{k}", date(2024, 4, 1 + k % 28)) for k in range(3000)] + [(5000 + k, None, None) for k in range(2000)]
    more += [(9000, "http://bad.com/" + "x" * 100_000, date(2024, 4, 1)), (9001, "http://" + "a." * 200 + "bad.com/", date(2024, 4, 1))]
    c = c.unionByName(spark.createDataFrame([(*x, "salt") for x in more], c.schema))
    salts = {r.hot_key: r.salts for r in url_filter.hot_keys(c).collect()}
    assert salts["com"] > 500 and salts["bad.com"] > 500 and salts[None] > 300
    again = {r.page_id: (r.blocked, r.lists) for r in url_filter.url_filter(c, e).collect()}
    assert {k: again[k] for k in got} == got and len(again) == 5013
    assert all(again[100 + k] == (True, "l") for k in range(3000)) and again[5000] == (False, "") and again[9000] == (True, "l") and again[9001] == (False, "")
    assert not any(r.blocked for r in url_filter.url_filter(c, e.limit(0)).collect()) and url_filter.url_filter(c.limit(0), e).count() == 0


def test_license_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    end = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(1, f"Intro. {mit}{end}", "s"), (2, mit, "s"), (3, "Released under the MIT License. And more.", "s"), (4, None, "s"), (5, "", "s"), (6, mit.replace("\n\n", "\nSomething else.\n"), "s"), (3, "Released under the MIT License. And more.", "s"), (None, "x\nLicensed under CC BY-NC 4.0.", "s")]
    got = {(r.doc_id, r.license, r.first_sentence, r.n_sentences) for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert got == {(1, "MIT", 1, 3), (2, "MIT", 0, 2), (3, "MIT", 0, 1), (None, "CC-BY-NC-4.0", 1, 1)}
    assert licenses.license_scan(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
