"""Hard negatives against every pair, and what the index visits."""

import math
import random

import duckdb
import numpy as np
import pytest

from reckonry.llm import op13_negatives as mine
from reckonry.plans.check import rows_of, sql_connection

SMALL = dict(codes=4, sample=40, shelf=16, block=3, seed_rows=10)
SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell string, score int"


def _odd_rows():
    draw = random.Random(9)
    rows = []
    for i in range(260):
        middle = draw.randrange(3)
        v = [draw.gauss(1.0 if k % 3 == middle else 0.0, 0.3) for k in range(12)]
        rows.append((i * draw.choice([1, 10, 25]), v, draw.randrange(4)))
    rows += [(700 + k, [0.5] * 12, k % 3) for k in range(60)]  # one common vector
    rows += rows[100:104]  # rows that repeat
    rows += [(100, None, 1), (200, [], 1), (300, [0.1, None] + [0.0] * 10, 2), (400, [float("nan")] * 12, 3), (500, [float("inf")] * 12, 3),
             (600, [0.3] * 12, None), (None, [0.4] * 12, 2), (None, [0.4] * 12, 3), (-100, [0.2] * 12, 0), (800, [-0.3] * 12, 0), (900, [1.0, 2.0], 9)]
    return [(*r, "x", "y", 1) for r in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(_odd_rows(), SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return path


def _brute(rows):
    """The contract by plain loops; returns sorted result rows."""
    use = []
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        use.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, v + [0] * (12 - len(v))))
    out = []
    late = lambda i: (i is None, i or 0)
    for a, (vec_id, label, v) in enumerate(use):
        if vec_id is None or vec_id % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), late(i), i, other) for b, (i, other, w) in enumerate(use) if b != a]
        for minus, _, positive, other in sorted([s for s in scored if s[3] == label], key=lambda s: s[:2])[:5]:
            fits = sorted([s for s in scored if s[3] != label and 30 * -minus <= -100 * s[0] <= 90 * -minus], key=lambda s: s[:2])
            out += [(vec_id, positive, k + 1, s[2], -minus, -s[0]) for k, s in enumerate(fits[:10])]
    return sorted(out, key=str)


def test_against_every_pair(spark, odd):
    got = mine.hard_negatives(spark.read.parquet(f"{odd}/embeddings.parquet"), **SMALL)
    want = _brute(_odd_rows())
    assert len(want) > 500
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_query_against_its_sql(spark, odd):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{odd}/embeddings.parquet/*.parquet'")
    got, want = mine.QUERY(spark, str(odd)), con.sql(mine.SQL)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_no_rows_and_no_usable_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert mine.hard_negatives(none).collect() == []
    assert mine.hard_negatives(spark.createDataFrame([(100, None, 1, "", "", 0)], SCHEMA)).collect() == []
    assert mine.hard_negatives(spark.createDataFrame([(100, [], 1, "", "", 0), (3, [], 1, "", "", 0), (4, [], 2, "", "", 0)], SCHEMA)).collect() == [
        (100, 3, 1, 4, 0, 0)]


def test_bounds_hold_and_cells_come_in_order(spark, odd):
    rows, width = mine.usable(spark.read.parquet(f"{odd}/embeddings.parquet"))
    laid, index = mine.indexed(rows, width, 4, 40, 16)
    held = laid.collect()
    assert sum(index.rows) == len(held) == rows.count()
    v = np.array([r["v"] for r in held])
    cells = [a * 4 + b for a, b in zip(mine.nearest(v[:, :width // 2].astype(float), index.books[0])[0], mine.nearest(v[:, width // 2:].astype(float), index.books[1])[0])]
    for r, c in zip(held, cells):
        assert r["shelf"] in index.shelves(c)
    sizes = {}
    for r in held:
        sizes[r["shelf"]] = sizes.get(r["shelf"], 0) + 1
    assert max(sizes.values()) <= 2 * 16 and len(sizes) > 10  # the common vector fills several shelves
    for q in v[:20].astype(float):
        bounds = {c: (up, low) for c, up, low in index.visits(q)}
        assert list(bounds) == sorted(bounds, key=lambda c: -bounds[c][0])
        for s, c in zip(v @ q, cells):
            assert bounds[c][1] <= s <= bounds[c][0]


def test_far_cells_are_not_visited():
    """Two groups far apart: a certified window stops before the other group's cells."""
    draw = np.random.default_rng(1)
    v = np.concatenate([draw.normal(0, 4, (200, 8)) + 200, draw.normal(0, 4, (200, 8)) - 200])
    books = tuple(mine.fitted(h, 2) for h in (v[:, :4], v[:, 4:]))
    own = [mine.nearest(h, b) for h, b in zip((v[:, :4], v[:, 4:]), books)]
    radii = tuple(np.array([far[code == k].max() for k in range(2)]) for code, far in own)
    rows = np.bincount(own[0][0] * 2 + own[1][0], minlength=4)
    index = mine.Index(books, radii, rows, np.arange(4), np.ones(4, int))
    assert len(index.rest(v[0], [(0.9 * v[0] @ v[0], np.inf)])) == 1
    assert len(index.rest(v[0], [(-np.inf, np.inf)])) == 2


def test_exact_products():
    a = np.array([[2**40, 3]]), np.array([[2**20 + 1, 5]])
    assert mine.scores_of(*a)[0, 0] == 2**40 * (2**20 + 1) + 15
    with pytest.raises(ValueError):
        mine.scores_of(np.array([[2**40, 0]]), np.array([[2**30, 0]]))


def test_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    got, want = mine.QUERY(spark, folder), sql_connection(folder).sql(mine.SQL)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
