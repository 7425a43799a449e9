"""Queries that once took a part of their input, against the whole of it."""

import datetime
import re

import duckdb
import numpy as np
import pytest

from lacuna.plans import catalog
from tests.test_queries import plain


def agrees(spark, sf_dir, name):
    """The query against its SQL; the number of rows."""
    sql = catalog.ORACLE_SQL[name]
    con = duckdb.connect()
    for t in ("events", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    df = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    rows = sorted([plain(r[c]) for c in names] for r in df.collect())
    assert rows == sorted([plain(x) for x in r] for r in cur.fetchall())
    return len(rows)


def brute_torsion(inputs, dt=0.05, rate=0.01, decay=0.001):
    """Two dimensions, number by number; K is [[0, k], [-k, 0]]."""
    x = y = k = 0.0
    last, out = None, []
    for a, b in inputs:
        x, y = x + dt * (a - x + k * y), y + dt * (b - y - k * x)
        if last:
            k = (1 - decay) * k + rate * (a * last[1] - last[0] * b)
        last = a, b
        out.append((0.5 * ((x - a) ** 2 + (y - b) ** 2), x * x + y * y, 2 * k * k))
    return out


def test_torsion_folds_whole_sequences(spark, tmp_path):
    counts = {1: 1, 2: 20, 3: 21, 4: 250}
    day = datetime.datetime(2024, 1, 1)
    rows = [(1000 * u + i, day + datetime.timedelta(minutes=i), u, float((i * 37 + u * 11) % 101)) for u, n in counts.items() for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["cid"], r["step"]): (r["energy"], r["norm_x"], r["norm_k"]) for r in catalog.QUERIES["torsion_state"](spark, str(tmp_path)).collect()}
    assert len(got) == sum(counts.values())
    for u in counts:
        for i, want in enumerate(brute_torsion([(v / 100, e % 5 / 5) for e, _, w, v in rows if w == u])):
            assert got[u, i + 1] == pytest.approx(want, abs=2e-6)


def test_torsion_whole_table(spark, sf_dir):
    n = agrees(spark, sf_dir, "torsion_state")
    assert n == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_bits_of_whole_texts(spark, sf_dir):
    agrees(spark, sf_dir, "bits_of_bytes")
    texts = {r["item_id"]: re.sub("[^ -~]", "?", r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r["item_id"]: np.packbits(np.array(r["bits"], np.uint8)).tobytes().decode() for r in catalog.QUERIES["bits_of_bytes"](spark, sf_dir).collect()}
    assert got == texts and max(map(len, texts.values())) > 4


def test_every_object_is_unpacked(spark, sf_dir):
    n = agrees(spark, sf_dir, "unpack_range")
    assert n == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_every_supplier_gossips(spark, tmp_path):
    keys = [0, 3, 16, 17, 18, 40, *range(100, 2000, 90)]
    rows = [(k, (k * 7 + i * i * 13) % 70_000) for k in keys[1:] for i in range(150)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    have = [{p for s, p in rows if s == k and p <= 65535} for k in keys]
    want = []
    for r in range(4):
        want += [(r, i, len(h)) for i, h in enumerate(have) if h]
        have = [h | set(sorted(have[(i + 1) % len(keys)] - h)[:64]) for i, h in enumerate(have)]
    got = sorted((r["round"], r["peer"], r["n"]) for r in catalog.QUERIES["gossip_rounds"](spark, str(tmp_path)).collect())
    assert got == sorted(want)
