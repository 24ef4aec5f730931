"""The range join against all pairs by brute force."""

import numpy as np
import pytest

from tabloom.llm import embed_dedup


def brute(rows, threshold=0.93):
    """[(vec_id, n_links, component_id, kept)] of (vec_id, vector, label) rows."""
    n = len(rows)
    units = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        u = np.array(v, float) if ok else None
        units.append(u / np.abs(u).max() / np.linalg.norm(u / np.abs(u).max()) if ok else None)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                linked[i, j] = linked[j, i] = units[i] @ units[j] >= threshold
    root = list(range(n))
    for i in sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0])):
        if root[i] == i:
            todo, seen = [i], {i}
            while todo:
                for k in np.flatnonzero(linked[todo.pop()]):
                    if k not in seen:
                        seen.add(k)
                        todo.append(k)
            for k in seen:
                if rows[k][0] is not None and (rows[root[k]][0] is None or rows[i][0] < rows[root[k]][0]):
                    root[k] = i
    out = []
    for i in range(n):
        part = rows[root[i]][0]
        out.append((rows[i][0], int(linked[i].sum()), part, rows[i][0] == part if part is not None else True))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in embed_dedup.similar_vectors(df).collect()], key=str)


@pytest.fixture
def small_cells(monkeypatch):
    """Sizes at which a few hundred vectors already have pivots, cores and several blocks."""
    for name, value in (("CELL", 40), ("BLOCK", 16)):
        monkeypatch.setattr(embed_dedup, name, value)


def planted(seed, n=240, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = centres[0] + rng.normal(size=dim) * 0.08  # one large group of near copies
        elif i % 5 == 0:
            v = centres[rng.integers(1, 6)] + rng.normal(size=dim) * 0.25
        elif i % 7 == 0:
            v = centres[5]
        else:
            v = rng.normal(size=dim)
        rows.append((i, [float(x) for x in v], int(i % 11 == 0)))
    return rows


SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_cores_and_blocks(spark, small_cells, seed):
    rows = planted(seed)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert result(df) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1e200, 1e199], 0), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0),
        (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, None, None), (13, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("group", "vector", "cell", "n", "same", "home", "copies"):
        df = df.selectExpr("*", f"1 AS `{name}`")
    assert result(df) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_very_common_vector(spark, small_cells):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, -5.0], 0) for i in range(300)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
