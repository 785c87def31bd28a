from datetime import date, datetime

import pytest

from shareflow.sinks import export, ingest
from shareflow.streaming import ingest as streaming

SCHEMA = "code string, date date, participant_id string, participant_name string, shares long, pct_of_issued double, source string, fetched_at timestamp"


def rows(spark, *given):
    return spark.createDataFrame([(c, date.fromisoformat(d), p, "N", s, 1.0, "x", datetime(2024, 1, 1, h)) for c, d, p, s, h in given], SCHEMA)


def found(spark, path):
    return {(r.code, str(r.date), r.participant_id): r.shares for r in spark.read.schema(SCHEMA).parquet(path).collect()}


@pytest.fixture
def batches(spark):
    a = rows(spark, ("00001", "2024-01-02", "B00001", 10, 1), ("00001", "2024-01-02", "B00002", 20, 1), ("00001", "2024-01-03", "B00001", 11, 1))
    b = rows(spark, ("00001", "2024-01-03", "B00001", 12, 3), ("00001", "2024-01-03", "B00001", 99, 2), ("00002", "2024-01-03", "C00001", 5, 1))
    return a, b


WANT = {("00001", "2024-01-02", "B00001"): 10, ("00001", "2024-01-02", "B00002"): 20, ("00001", "2024-01-03", "B00001"): 12, ("00002", "2024-01-03", "C00001"): 5}


def test_last_write_wins_and_is_idempotent(spark, tmp_path, batches):
    path = str(tmp_path / "snapshots")
    for batch in (*batches, batches[0], batches[1]):
        ingest.upsert_snapshots(path, batch)
    assert found(spark, path) == WANT


def test_streaming_gives_what_batches_give(spark, tmp_path, batches):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{source}/{k}")
    stream = streaming.landed(spark, f"{source}/*", SCHEMA, 1)
    streaming.ingest_snapshots(stream, target, checkpoint).awaitTermination(120)
    streaming.ingest_snapshots(stream, target, checkpoint).awaitTermination(120)
    assert found(spark, target) == WANT


def test_prices_are_cleaned(spark, tmp_path):
    raw = spark.createDataFrame([("00001", "24-01-02", "yahoo", "1,234.5", "bad", "x", datetime(2024, 1, 1)), ("00001", None, "yahoo", "1", "1", "1", datetime(2024, 1, 1))], "code string, date string, price_source string, close string, open string, volume string, fetched_at timestamp")
    assert ingest.upsert_prices(str(tmp_path / "p"), raw) == 1
    r = spark.read.parquet(str(tmp_path / "p")).first()
    assert (str(r.date), r.close, r.open, r.volume) == ("2024-01-02", 1234.5, None, 0)


def test_meta_keeps_what_a_batch_leaves_blank(spark):
    schema = "code string, name string, issued_shares long, issued_shares_as_of date"
    old = spark.createDataFrame([("1", "A", 10, date(2024, 1, 1)), ("2", "B", 20, date(2024, 1, 1))], schema)
    new = spark.createDataFrame([("1", " ", None, date(2024, 2, 1)), ("3", "C", 30, None)], schema)
    got = {r.code: tuple(r)[1:] for r in ingest.merged_meta(old, new).collect()}
    assert got == {"1": ("A", 10, date(2024, 2, 1)), "2": ("B", 20, date(2024, 1, 1)), "3": ("C", 30, None)}


def test_daily_ingest_reports_every_code(spark, tmp_path):
    watch = spark.createDataFrame([("00001",), ("00002",)], "code string")
    landed = spark.createDataFrame([("00001", date(2024, 1, 2), "yahoo", 1.0, 5, datetime(2024, 1, 1)), ("00009", date(2024, 1, 2), "yahoo", 1.0, 5, datetime(2024, 1, 1))], "code string, date date, price_source string, close double, volume long, fetched_at timestamp")
    got = {r.code: (r.rows, r.ok) for r in ingest.daily_ingest(watch, landed, str(tmp_path / "p")).collect()}
    assert got == {"00001": (1, True), "00002": (0, False)}
    assert {r.code for r in spark.read.parquet(str(tmp_path / "p/prices")).collect()} == {"00001"}


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([("1", date(2024, 1, 1), 5, ["x", "y"])], "code string, date date, n int, tags array<string>")
    b = spark.createDataFrame([("1", float("nan"))], "code string, v double")
    w = spark.createDataFrame([("1", "careful")], "code string, warning string")
    out = export.combined({"a": a, "b": b}, "test", warnings=w)
    got = {r.section: r for r in out.collect()}
    assert got["a"].n == "5" and got["a"].tags == '["x","y"]' and got["b"].n is None and got["warnings"].record_type == "warning"
    assert out.columns[: len(export.PROVENANCE)] == export.PROVENANCE
    export.write_csv(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    export.write_json({"a": a, "b": b}, str(tmp_path / "json"))
    records = {r.section: r.value for r in spark.read.text(str(tmp_path / "json")).collect()}
    assert records["b"] == '{"code":"1"}' and '"n":5' in records["a"]


def test_derived_tables_follow_late_and_corrected_snapshots(spark, tmp_path):
    """After each wave the derived tables are what a full run over the stored snapshots gives, and untouched dates aren't written."""
    import random

    from shareflow.operators import snapshots

    schema = "code string, date date, participant_id string, participant_name string, shares long, bps long, fetched_at int"
    rng = random.Random(4)
    made = [(c, date(2024, 1, 1 + d), f"B{p:05d}", f"n{p}", rng.randrange(1, 99), rng.choice([None, 5, 9])) for c in "ab" for d in range(8) for p in range(5) if rng.random() < 0.7]
    waves = [[r for r in made if r[1].day in (2, 5, 8)], [r for r in made if r[1].day in (1, 3, 6) and r[0] == "a"], [(*r[:4], r[4] + 7, r[5]) for r in made if r[1].day == 5], [r for r in made if r[1].day in (4, 7)] * 2]
    target, derived = str(tmp_path / "snapshots"), str(tmp_path / "derived")
    same = lambda a, b: sorted(map(str, map(tuple, a.select(b.columns).collect()))) == sorted(map(str, map(tuple, b.collect())))
    stamps = {}
    for k, wave in enumerate(waves):
        spark.createDataFrame([(*r, k) for r in wave], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        streaming.maintain(streaming.landed(spark, f"{tmp_path}/in/*", schema, 1), target, derived, str(tmp_path / "cp")).awaitTermination(120)
        stored = spark.read.parquet(target)
        assert same(spark.read.parquet(f"{derived}/changes"), snapshots.consecutive_changes(stored))
        assert same(spark.read.parquet(f"{derived}/concentration"), snapshots.concentration_series(stored))
        files = {p.parent.name: p.name for p in (tmp_path / "derived" / "concentration").glob("date=*/*.parquet")}
        if k:
            touched = {f"date={r[1]}" for r in wave}
            assert all(files[d] == stamps[d] for d in stamps if d not in touched) and all(files[d] != stamps.get(d) for d in touched)
        stamps = files


def test_metadata_goes_with_the_records(spark):
    rows = spark.createDataFrame([("1", 5)], "code string, shares long")
    got = {(r.section, r.code, r.record) for r in export.json_records({"holdings": rows}, spark.createDataFrame([("1", "One", float("nan"))], "code string, name string, price double")).collect()}
    assert got == {("holdings", "1", '{"code":"1","shares":5}'), ("metadata", "1", '{"code":"1","name":"One"}')}
