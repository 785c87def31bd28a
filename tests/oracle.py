"""Holds a registered query against its SQL in DuckDB on the driver's smallest tables."""

import math
import os
from collections import Counter
from datetime import datetime

import duckdb

from shareflow.sources.views import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HAVE_DATA = os.path.isdir(SF_DIR)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.date()
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def agrees(spark, query, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    df = query(spark, SF_DIR)
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    return rows(df.columns, map(tuple, df.collect())) == rows(columns, found.fetchall())
