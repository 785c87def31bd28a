"""The first batch of a table goes straight to it; later ones by way of a staging table."""

from pathlib import Path

from shareflow.sinks import ingest


def test_staging_only_where_a_table_is_read(spark, tmp_path):
    path, staging = str(tmp_path / "t"), Path(f"{tmp_path}/t_staging")
    rows = lambda at, *values: spark.createDataFrame([("c", d, "p", v, at) for d, v in values], "code string, date string, participant_id string, shares long, fetched_at int")
    ingest.upsert_snapshots(path, rows(1, ("2024-01-01", 1), ("2024-01-02", 2)))
    assert not staging.exists()
    ingest.upsert_snapshots(path, rows(2, ("2024-01-02", 3)))
    assert staging.exists()
    assert sorted((str(r.date), r.shares) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 3)]
