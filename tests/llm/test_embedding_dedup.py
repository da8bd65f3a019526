"""Near-duplicate vectors against all pairs in double precision."""

import numpy as np
import pytest

from fundlens.llm import embedding_dedup as dedup


def brute(rows, threshold):
    """(id, links, component, kept) per row; a null id comes last."""
    unit = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.abs(v).max() if good else None)
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    links = [[j for j in range(len(rows)) if j != i and near(unit[i], unit[j])] for i in range(len(rows))]
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((own, len(links[i]), least, least == own))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def check(spark, rows, threshold):
    found = [tuple(r) for r in dedup.grouped(table(spark, rows), threshold).collect()]
    assert order(found) == order(brute(rows, threshold))


def clustered(rng, n, dim, spread):
    centres = rng.normal(size=(4, dim))
    size = rng.choice([1e-3, 1.0, 1e4], n)[:, None]
    return (centres[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dim))) * size


@pytest.mark.parametrize(("tile", "dim", "spread"), [(8192, 8, 0.25), (30, 8, 0.3), (7, 16, 0.2), (40, 3, 0.1)])
def test_links_and_components_equal_brute_force(spark, monkeypatch, tile, dim, spread):
    monkeypatch.setattr(dedup, "TILE", tile)
    rows = clustered(np.random.default_rng(tile), 150, dim, spread)
    check(spark, [(1000 - k, v.tolist()) for k, v in enumerate(rows)], 0.95)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 4)
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
        (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e280]), (11, [1e-300, 0.0]), (None, [5.0, 0.0]),
        (None, [0.0, 1.0]), (None, [0.0, 3.0]), (12, [-1.0, 0.0]), (13, [0.0, -1.0]),
    ]
    check(spark, rows, 0.95)
    check(spark, rows[:1], 0.95)
    assert dedup.grouped(table(spark, [])).count() == 0
    extra = table(spark, rows).selectExpr("vec_id", "embedding", "vec_id as row", "'x' as dim", "1 as vector")
    assert order(tuple(r) for r in dedup.grouped(extra).collect()) == order(brute(rows, 0.95))
    with pytest.raises(ValueError, match="threshold"):
        dedup.grouped(extra, 0.0)


def test_pairs_around_the_threshold():
    """Angles a hair to either side of the threshold are told apart."""
    angle = np.arccos(0.95) + np.array([-1e-9, 1e-9, -1e-6, 1e-6, -1e-3, 1e-3])
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    unit = np.concatenate([basis[:1], np.cos(angle)[:, None] * basis[0] + np.sin(angle)[:, None] * basis[1]])
    found = dedup.Quantised(dedup.unit_rows(unit))
    linked = {int(j) for i, js in dedup.near_pairs(found, found, 0.95, True) for i, j in zip(i, js, strict=True) if i == 0}
    assert linked == {1, 3, 5}


@pytest.mark.parametrize("dim", [1, 64, 1040, 1041, 3000])
def test_bounds_hold(dim):
    """The coarse interval holds the cosine, and products are exact in any number of components."""
    rng = np.random.default_rng(dim)
    a, b = (dedup.Quantised(dedup.unit_rows(rng.normal(size=(40, dim)) ** 3 + 1e-9)) for _ in range(2))
    whole = a.products(slice(0, 40), b)
    assert (whole == a.q.astype(np.int64) @ b.q.astype(np.int64).T).all()
    coarse = whole * a.scale[:, None] * b.scale
    spread = a.length[:, None] * b.error + a.error[:, None] * (b.length + b.error)
    assert (np.abs(coarse - a.unit @ b.unit.T) <= spread).all()


def test_a_tile_returns_no_pairs(spark, monkeypatch):
    """A third of the vectors are near copies: rows of the tiles stay linear."""
    monkeypatch.setattr(dedup, "TILE", 100)
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=16) + 1e-4 * rng.normal(size=(100, 16))])
    base = table(spark, [(k, v.tolist()) for k, v in enumerate(rows)])
    check(spark, [(k, v.tolist()) for k, v in enumerate(rows)], 0.95)
    dealt = dedup.tiles(base.selectExpr("vec_id", "embedding as vector", "vec_id as row"))
    assert dealt.count() == 3 * len(rows)
