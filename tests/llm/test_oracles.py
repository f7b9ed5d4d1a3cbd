"""The SQL of the queries that have one, on small tables with groups, ties and broken rows."""

import random

import duckdb
import pandas as pd

from warraq.llm import embedding_dedup, queries, warc


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(None if pd.isna(x) else x for x in r) for r in frame.astype(object).itertuples(index=False, name=None))


def both(ours, sql, **tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t.toArrow())
    return rows(ours.toPandas()), rows(c.execute(sql).df())


def test_embeddings(spark):
    rng = random.Random(3)
    data, at = [], 0
    for size in (1, 2, 5, 9, 30):
        centre = [rng.gauss(0, 1) for _ in range(32)]
        for _ in range(size):
            data.append((at, [x + rng.gauss(0, 0.12) for x in centre]))
            at += 1
    data += [(at, data[0][1]), (at + 1, None), (at + 2, [0.0] * 32), (at + 3, [float("nan")] * 32), (at + 4, [None] * 32), (at + 5, [float("inf")] * 32)]
    t = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got, want = both(embedding_dedup.near_duplicates(t), queries.OP1_SQL, embeddings=t)
    assert got == want and sum(r[2] for r in got) > 100


def test_archives(spark):
    long, short = "é" * 600, "é" * 400
    data = [(1, long), (5, long), (3, long), (2, short), (4, short), (6, None), (7, ""), (8, "x" * 999), (9, "x" * 999), (10, "y" * 1000), (11, "y" * 1000)]
    t = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in data], "page_id long, url string, html string")
    got, want = both(warc.round_trip(t), queries.OP4_SQL, pages=t)
    assert got == want and sum("revisit" in r for r in got) == 3
