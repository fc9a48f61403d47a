"""Hard negatives against a search of all rows."""

import math

import duckdb
import numpy as np
import pytest

from barwright.llm import negatives
from barwright.llm.queries import ORACLES, QUERIES

SCHEMA = "id long, label int, vector array<double>, anchor boolean, score int, cell int, part int, rank int"


def plain(rows, positives=5, negs=5, low=80, high=100):
    fit = {}
    for i, label, v, anchor in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit[i] = min(fit[i], (label, v, anchor)) if i in fit else (label, v, anchor)
    most = max((len(v) for _, v, _ in fit.values()), default=0)
    names = np.array(sorted(fit), np.int64)
    vectors = np.array([[*fit[i][1], *[0] * (most - len(fit[i][1]))] for i in names], np.int64).reshape(len(names), most)
    labels, out = np.array([fit[i][0] for i in names]), set()
    for i in names[[bool(fit[i][2]) for i in names]] if len(names) else []:
        at = int(np.flatnonzero(names == i)[0])
        scores = vectors @ vectors[at]
        order = sorted(range(len(names)), key=lambda k: (-scores[k], names[k]))
        for p in [k for k in order if labels[k] == labels[at] and k != at][:positives]:
            hard = [k for k in order if labels[k] != labels[at] and low * scores[p] <= 100 * scores[k] <= high * scores[p]]
            out |= {(int(i), int(names[p]), r + 1, int(names[k]), int(scores[p]), int(scores[k])) for r, k in enumerate(hard[:negs])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(4)


def clustered(n, dims, seed, spread):
    """Vectors about a few centres, with equal vectors and equal scores among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 80
    v = np.round(centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * spread)
    v[n // 2 : n // 2 + n // 8] = v[0]
    label = rng.integers(0, 4, n)
    return [(int(i), int(label[i]), v[i].tolist(), bool(i % 20 == 0)) for i in range(n)]


@pytest.mark.parametrize(("dims", "spread", "words"), [(8, 4, 6), (5, 30, 3), (1, 20, 2)])
def test_equals_a_search_of_all_rows(spark, monkeypatch, dims, spread, words):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "FIRST_ROWS", 30)
    rows = clustered(400, dims, dims, spread)
    got = [tuple(r) for r in negatives.hard_negatives(frame(spark, rows), words=words).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_cells_come_by_falling_bound_and_bound_all_rows():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, 6)) * 50
    index = negatives.MultiIndex([negatives.trained(h, 5) for h in (rows[:, :3], rows[:, 3:])])
    (a, ra), (b, rb) = (negatives.nearest(h, book) for h, book in zip(index.halves(rows), index.books, strict=True))
    cell = a * 5 + b

    class Row:
        pass

    counted = []
    for c in np.unique(cell):
        r = Row()
        r.cell, r.n, r.radius_a, r.radius_b = int(c), int((cell == c).sum()), ra[cell == c].max(), rb[cell == c].max()
        counted.append(r)
    index.count(counted)
    for q in rng.normal(size=(20, 6)) * 50:
        seen = list(index.cells(q))
        assert sorted(c for _, c, _, _ in seen) == sorted(np.unique(cell))
        bounds = [x[0] for x in seen]
        assert bounds == sorted(bounds, reverse=True)
        for bound, c, top, bottom in seen:
            scores = rows[cell == c] @ q
            assert bottom <= scores.min() and scores.max() <= top <= bound + 1e-6


def test_visits_stop_on_certified_windows(spark, monkeypatch):
    """Tight clusters: an anchor asks for a few of the cells only."""
    monkeypatch.setattr(negatives, "FIRST_ROWS", 30)
    asked = []
    found = negatives.Scratch.table

    def table(self, df, name):
        out = found(self, df, name)
        if name == "visits":
            asked.append(out.where("cell >= 0").count())
        return out

    monkeypatch.setattr(negatives.Scratch, "table", table)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 100
    rows = [(int(i), int(i % 2), np.round(centres[i % 12 // 2 * 2] + rng.normal(size=8)).tolist(), bool(i % 50 == 0)) for i in range(600)]
    got = {tuple(r) for r in negatives.hard_negatives(frame(spark, rows), words=6).collect()}
    assert got == plain(rows)
    assert sum(asked) < 12 * 36 * 2 / 3


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [3.0, 4.0], True), (0, 1, [3.0, 4.0], True), (None, 1, [3.0, 4.0], True), (1, None, [3.0, 4.0], False), (2, 1, None, False), (3, 1, [3.0, None], False), (4, 2, [nan, 1.0], False),
        (5, 2, [inf, 1.0], False), (6, 1, [3.0, 4.0], False), (7, 1, [3.0, 4.0], None), (8, 2, [3.0, 4.0], False), (9, 2, [3.0], True), (10, 2, [], False), (-11, 3, [3.0, 3.0], False), (12, 3, [3.0, 3.0], True),
    ]
    assert {tuple(r) for r in negatives.hard_negatives(frame(spark, rows)).collect()} == plain(rows) != set()
    assert negatives.hard_negatives(frame(spark, [])).collect() == []
    alone = [(i, i, [1.0, 2.0], True) for i in range(3)]  # no positives
    assert negatives.hard_negatives(frame(spark, alone)).collect() == []
    assert negatives.hard_negatives(frame(spark, [(i, 1, [1.0], False) for i in range(3)])).collect() == []  # no anchors


def test_query_equals_its_twin(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = QUERIES["op11_hard_negatives"](spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(ORACLES["op11_hard_negatives"])
    at = [[d[0] for d in want.description].index(c) for c in names]
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("big", [3e6, 2.0**28])
def test_large_components_take_part(spark, monkeypatch, big):
    """Components of any size take part; scores beyond what a double holds are exact, and windows too."""
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "FIRST_ROWS", 30)
    rows = clustered(200, 4, 3, 10)
    rng = np.random.default_rng(2)
    for k in (3, 20, 77, 140):
        i, label, v, anchor = rows[k]
        rows[k] = (i, label, [*rng.integers(-big // 2, big // 2, 3).astype(float).tolist(), big + k], anchor)
    got = [tuple(r) for r in negatives.hard_negatives(frame(spark, rows), words=4).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert {3, 77} & {r[1] for r in got} and max(r[4] for r in got) > 2**43


def test_products_are_exact():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(1 << 30), 1 << 30, (7, 5)).astype(float), rng.integers(-(1 << 29), 1 << 29, (9, 5)).astype(float)
    a[0], b[0] = [2.0**90, 3, -(2.0**90), 1, 2], [1, 2.0**40 + 1, 1, 5, 7]  # the huge terms go
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    got = negatives.products(a, b)
    for i, row in enumerate(want):
        assert got[i].tolist() == [max(-negatives.WIDEST, min(negatives.WIDEST, x)) for x in row]
    assert got[0, 0] == 3 * (2**40 + 1) + 19


def test_query_takes_large_components(spark, sf_dir, tmp_path):
    """The query against its contract, where some components are of 4,096 and more."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150).toPandas()
    rows["embedding"] = [[float(x) * (1e6 if i % 3 == 1 else 1) for x in v] for i, v in zip(rows.vec_id, rows.embedding, strict=True)]
    spark.createDataFrame([(int(i), int(y), v) for i, y, v in zip(rows.vec_id, rows.label, rows.embedding, strict=True)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    moved = [(int(i), int((y + 1) % 10 if i % 7 == 0 else y), [math.floor(256 * float(np.float32(x))) for x in v], i % 100 == 0) for i, y, v in zip(rows.vec_id, rows.label, rows.embedding, strict=True)]
    assert {tuple(r) for r in got.collect()} == plain(moved) != set()
    assert any(abs(x) >= 1 << 20 for _, _, v, _ in moved for x in v)


def test_blocks_meet_in_any_number_of_partitions(spark, monkeypatch):
    """A block of anchors and its block of rows are dealt to the same task, also where partitions aren't put together."""
    monkeypatch.setattr(negatives, "BLOCK", 15)
    monkeypatch.setattr(negatives, "FIRST_ROWS", 150)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = clustered(400, 6, 11, 20)
        assert {tuple(r) for r in negatives.hard_negatives(frame(spark, rows), words=3).collect()} == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
