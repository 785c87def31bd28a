"""Changes by sweep, band joins, rule tables, tag scans and means over known values, against plain Python."""

import random
import re
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shareflow.functions import rules
from shareflow.operators import flows, prices, snapshots

SNAPS = "code string, date date, participant_id string, participant_name string, shares long, bps long"


def some_snapshots(seed=1, codes="ab", days=7, people=6):
    rng = random.Random(seed)
    return [(c, date(2024, 1, 1) + timedelta(days=d * d), f"B{p:05d}", f"name {p} {d}", rng.randrange(1, 50), rng.choice([None, 10, 20])) for c in codes for d in range(days) for p in range(people) if rng.random() < 0.6]


def test_changes_in_one_sweep(spark):
    rows = some_snapshots() + [("single", date(2024, 1, 1), "B00001", "x", 5, 1)]
    want = Counter()
    for code in {r[0] for r in rows}:
        dates = sorted({r[1] for r in rows if r[0] == code})
        for before, day in zip(dates, dates[1:], strict=False):
            a, b = ({r[2]: r for r in rows if r[:2] == (code, d)} for d in (before, day))
            for p in a.keys() | b.keys():
                x, y = a.get(p), b.get(p)
                stake = y[5] - x[5] if x and y and x[5] is not None and y[5] is not None else None
                want[code, day, p, (y or x)[3], (y[4] if y else 0) - (x[4] if x else 0), stake, y[4] if y else 0, y[5] if y else None] += 1
    df = spark.createDataFrame(rows, SNAPS)
    got = snapshots.consecutive_changes(df)
    assert got.columns == ["code", "date", "participant_id", "participant_name", "change_shares", "change_bps", "shares_after", "bps_after"]
    assert Counter(map(tuple, got.collect())) == want
    assert snapshots.consecutive_changes(df.limit(0)).count() == 0


def test_changes_read_a_table_once(spark, tmp_path):
    spark.createDataFrame(some_snapshots(), SNAPS).write.parquet(f"{tmp_path}/snaps")
    df = spark.read.parquet(f"{tmp_path}/snaps")
    plan = lambda x: x._jdf.queryExecution().sparkPlan().toString()
    swept = snapshots.consecutive_changes(df)
    assert plan(swept).count("FileScan parquet") == 1 and swept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    pairs = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 1, 5))], "code string, date_a date, date_b date")
    assert plan(snapshots.diff(df, pairs)).count("FileScan parquet") == 1


def test_diff_of_pairs_that_share_dates(spark):
    rows = some_snapshots(2)
    df = spark.createDataFrame(rows, SNAPS)
    dates = sorted({r[1] for r in rows if r[0] == "a"})
    pairs = [("a", dates[0], dates[-1]), ("a", dates[1], dates[-1]), ("a", dates[0], dates[1]), ("a", dates[0], dates[1])]
    got = Counter((r.date_a, r.date_b, r.participant_id, r.shares_a, r.shares_b, r.status) for r in snapshots.diff(df, spark.createDataFrame(pairs[:3], "code string, date_a date, date_b date")).collect())
    want = Counter()
    for _, x, y in pairs[:3]:
        a, b = ({r[2]: r[4] for r in rows if r[:2] == ("a", d)} for d in (x, y))
        for p in a.keys() | b.keys():
            s, t = a.get(p), b.get(p)
            want[x, y, p, s or 0, t or 0, "new" if s is None else "exited" if t is None else "increased" if t > s else "decreased" if t < s else "unchanged"] += 1
    assert got == want


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 2.0, 7.3])
def test_transfers_within_a_band(spark, tolerance):
    rng = random.Random(3)
    rows = [("a", date(2024, 1, 1 + k % 3), f"p{k}", round(rng.choice([-1, 1]) * rng.uniform(5, 40), 1)) for k in range(150)]
    got = Counter((r.date, r.gained_by, r.lost_by) for r in flows.transfer_pairs(spark.createDataFrame(rows, "code string, date date, participant_name string, change_pct double"), 10.0, tolerance).collect())
    want = Counter((g[1], g[2], x[2]) for g in rows for x in rows if g[1] == x[1] and g[3] >= 10 and x[3] <= -10 and abs(abs(g[3]) - abs(x[3])) <= tolerance)
    assert got == want and (want or not tolerance)


def test_names_beside_flags(spark):
    gains = [("B1", "Big One", 900, 20000), ("B2", "Big Two", 800, 20000), ("B3", "Big Three Securities", 700, 20000), ("B4", "Big Four", 600, 20000), ("B5", "Small", 500, 1)]
    rows = [("a", date(2024, 1, 1), i, n, c, 0, c, b) for i, n, c, b in gains] + [("a", date(2024, 1, 1), f"C{k}", f"Sec broker {k}", 10 - k, 0, 1, None) for k in range(7)]
    rows += [("a", date(2024, 1, 1), "D1", "Seller", -5000, 0, 0, None), ("a", date(2024, 1, 1), "D2", "Other", -10, 0, 0, None), ("b", date(2024, 1, 1), "D1", "Seller", -10, 0, 0, None), ("b", date(2024, 1, 1), "D2", "Other", -9, 0, 0, None), ("b", date(2024, 1, 1), "D3", "Third", -8, 0, 0, None)]
    got = {r.code: r for r in flows.change_patterns(spark.createDataFrame(rows, "code string, date date, participant_id string, participant_name string, change_shares long, change_bps long, shares_after long, bps_after long")).collect()}
    assert got["a"].large_names == ["Big One", "Big Two", "Big Three Securities"]
    assert got["a"].broker_names == ["Big Three Securities", *(f"Sec broker {k}" for k in range(4))]
    assert got["a"].seller_name == "Seller" and got["b"].seller_name is None and got["b"].large_names == got["b"].broker_names == []


def test_mean_of_known_turnovers(spark):
    known = {k: 1000.0 if k < 8 else 100.0 for k in (*range(5, 8), *range(8, 30, 2))}
    rows = [("a", date(2024, 1, 1) + timedelta(days=k), "s", known.get(k)) for k in range(30)]
    rows += [("b", date(2024, 1, 1), "s", None)]
    for n in (20, 5, 1):
        got = {(r.code, r.date): r.mean_turnover for r in prices.trailing_turnover(spark.createDataFrame(rows, "code string, date date, price_source string, turnover double"), n).collect()}
        for k in range(30):
            last = [v for j, v in sorted(known.items()) if j <= k][-n:]
            assert got["a", rows[k][1]] == (pytest.approx(sum(last) / len(last)) if last else None)
        assert got["b", date(2024, 1, 1)] is None


def test_ten_thousand_rules(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "Q"
    words = [(k, word(rng.choice([1, 2, 3, 4, 5, 8, 12])) if k else "inside", f"c{k % 7}") for k in range(10_000)]
    words = [(p, w if len(w) > 2 or p > 9_900 else w + "XYZ", c) for p, w, c in words]
    names = [f"{word(20)} {k}" for k in range(300)] + ["xxINSIDEyy", "", None, "b"]
    people = [(f"B{k:05d}" if k % 2 else f"c{k:05d} ", n) for k, n in enumerate(names)] + [("B00001", "twice")]
    ids = [("b00001 ", "special"), ("C00002", "special2")]

    def expected(pid, name):
        pid = pid.strip().upper()
        by_id = {i.strip().upper(): c for i, c in ids}
        hits = [(p, c) for p, w, c in words if w.strip().upper() in (name or "").upper()]
        return by_id.get(pid) or (min(hits)[1] if hits else "bank" if pid.startswith("C") else "unknown")

    df = spark.createDataFrame(people, "participant_id string, participant_name string")
    got = rules.with_category_by(df, spark.createDataFrame(ids, "participant_id string, category string"), spark.createDataFrame(words, "priority int, keyword string, category string"))
    assert Counter(map(tuple, got.collect())) == Counter((i, n, expected(i, n)) for i, n in people)
    none = rules.with_category_by(df, spark.createDataFrame([], "participant_id string, category string"), spark.createDataFrame([], "priority int, keyword string, category string"))
    assert {r.category for r in none.collect()} == {"bank", "unknown"}


def test_tags_in_one_scan(spark):
    rng = random.Random(6)
    parts = [p for _, pattern in rules.EVENT_TAGS for p in pattern.replace(r"\b", "").replace("(?:e|ion)", "ion").replace("(?:ly)?", "").replace(".*", " of the ").split("|")]
    texts = [" ".join(rng.choice([*parts, "Cargo ", "vsas", "cbx", "boardroom", "Change", "name", "rights"]) for _ in range(rng.randrange(0, 6))) for _ in range(400)]
    texts += [a[: len(a) // 2 + 1] + b for a in parts[:20] for b in parts[:20]] + ["changed name", "name change", "a cb", "a cb b", "go ", "x go y", "ago y", "HIGHLY CONCENTRATED", "highconcentrat"]
    rows = [(k, rng.choice(["News", None]), t) for k, t in enumerate(texts)] + [(-1, None, None)]
    got = {r.k: r.tags for r in spark.createDataFrame(rows, "k int, c string, t string").select("k", rules.event_tags(F.col("c"), F.col("t")).alias("tags")).collect()}
    for k, c, t in rows:
        text = f"{c or ''} {t or ''}".lower()
        assert got[k] == sorted({tag for tag, pattern in rules.EVENT_TAGS if re.search(pattern, text)}), text


def test_cost_lines_and_markers(spark):
    text = "Placing, HK$1.2, 9\r\n,3K\nBlock,1.5m,x\nWords, ten\nno price\n Rights , $2 \n"
    got = prices.parse_cost_lines(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "code string, text string")).orderBy("line_no").collect()
    assert [(r.label, r.price) for r in got] == [("Placing", 1.2), ("Cost line", 3000.0), ("Block", 1_500_000.0), ("Rights", 2.0)]
    marks = prices.parse_event_markers(spark.createDataFrame([("a", "2024-01-05, first, second\n5 Jan 2024,x\nnone\n")], "code string, text string")).orderBy("line_no").collect()
    assert [(str(r.date), r.label) for r in marks] == [("2024-01-05", "first, second"), ("2024-01-05", "x")]
