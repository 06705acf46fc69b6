import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import ann


def expected(vecs, every, k):
    """By brute force: query id to [(id, cosine)], of every usable vector."""
    use = [(i, np.array(v, float)) for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in use:
        if q % every == 0:
            ids, rows = zip(*[(i, b) for i, b in use if i != q and len(b) == len(a)], strict=True) if any(i != q and len(b) == len(a) for i, b in use) else ((), ())
            if ids:
                a1, rows = a / np.abs(a).max(), np.stack(rows)
                rows = rows / np.abs(rows).max(axis=1, keepdims=True)
                score = (rows * a1).sum(axis=1) / np.sqrt((rows * rows).sum(axis=1)) / np.sqrt((a1 * a1).sum())
                order = np.lexsort((ids, -np.round(score, 12)))[:k]
                out[q] = [(ids[o], score[o]) for o in order]
    return out


def results(df, every, k, **more):
    got = {}
    for x in sorted(ann.nearest(df, F.col("vec_id") % every == 0, k, **more).collect(), key=lambda x: x["rank"]):
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert all([r for r, _, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [(i, s) for _, i, s in v] for q, v in got.items()}


def odd_vectors():
    r = np.random.default_rng(12)
    centres = r.normal(size=(12, 24))
    vecs = [(i, [float(x) for x in centres[i % 12] + r.normal(size=24) * r.choice([0.1, 1, 3])]) for i in range(1500)]
    vecs += [(3000 + i, vecs[50][1]) for i in range(700)]  # a third of all rows
    vecs += [(5000, None), (5010, [1.0, None] * 12), (5020, [float("nan")] * 24), (5030, [float("inf")] * 24), (5040, [0.0] * 24), (5050, [1.0, 2.0]), (5051, [2.0, 1.0]), (5100, [3.0]), (5110, [])]
    vecs += [(None, vecs[0][1]), (5200, [1e200] * 24), (5250, [1e-200] * 24), (5300, vecs[3][1])]
    return vecs


@pytest.mark.parametrize("limits", [(4096, 64, 512, 1 << 21), (128, 8, 16, 600)])
def test_search_with_certainty_equals_brute_force(spark, limits, monkeypatch):
    for name, x in zip(("TILE", "LEAF", "STRIP", "WAVE_NUMBERS"), limits, strict=True):
        monkeypatch.setattr(ann, name, x)
    vecs = odd_vectors()
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in vecs], "vec_id long, embedding array<double>, rank int, score double").repartition(5)
    got, want = results(df, 50, 5, probability=1.0, sample=500), expected(vecs, 50, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_by_chance(spark):
    r = np.random.default_rng(5)
    vecs = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(r.normal(size=(4000, 64)))]  # the hardest case: no structure at all
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(4)
    got, want = results(df, 20, 5), expected(vecs, 20, 5)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.95 * 5 * len(want) and all(len(v) == 5 for v in got.values())
    cosine = {q: dict(x) for q, x in expected(vecs, 20, 4000).items()}
    assert all(abs(s - cosine[q][i]) < 1e-12 for q, x in got.items() for i, s in x)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in results(df, 50, 5)[50]] == [1, 1, 2]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert ann.nearest(df, F.col("vec_id") == 77, 5).count() == 0


def test_quantiles_cells_and_leaves():
    assert abs(ann.chi_square_quantile(0.95, 2) + 2 * math.log(0.05)) < 1e-9 and abs(ann.chi_square_quantile(0.95, 16) - 26.296) < 1e-3
    points = np.random.default_rng(1).normal(size=(1000, 4))
    points[:300] = points[0]
    leaves = ann.split(points, 16)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 16
    nodes = ann.fit_cells(points, 16)
    cells = ann.cell_of(points, nodes)
    assert cells.min() == 1 and set(cells) == set(range(1, cells.max() + 1)) and len(set(cells[:300])) == 1 and not ann.fit_cells(points[:0], 16)
