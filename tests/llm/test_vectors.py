"""The vector operators against SQL and against plain versions, on odd rows, and what their bounds leave out."""

import hashlib
import math

import numpy as np
import pytest

from compare import DATA, duck, rows_of, rows_of_sql
from ridgeline.llm import hard_negatives, nearest, vafile
from ridgeline.llm.queries import ORACLES, QUERIES

NAN, INF = float("nan"), float("inf")
DDL = "vec_id bigint, embedding array<double>, label int, n int, v string, leaf int, node int, group int, q int, c int, rank int, score double, error int, code string, of_label int"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives", "op13_nearest"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_same_rows_as_sql(spark, name, sf):
    d = str(DATA / sf)
    assert rows_of(QUERIES[name](spark, d)) == rows_of_sql(duck(d), ORACLES[name])


def odd_vectors(scale: float = 1.0) -> list[tuple]:
    """Nulls, non-finite components, zeros, copies, repeated ids, ties, unequal lengths, null ids and labels."""
    rng = np.random.default_rng(5)
    rows = [(i, (scale * rng.integers(-8, 8, 6) / 4).tolist(), int(i) % 4) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1], i % 3) for i in range(60)]
    rows += [(300, None, 1), (301, [1.0, None, 2.0, 0.0, 0.0, 1.0], 1), (302, [NAN] * 6, 1), (303, [INF, 1.0, 1.0, 1.0, 1.0, 1.0], 2), (304, [0.0] * 6, 2), (305, [], 0), (306, [scale * 3.0, scale * -2.5], 1)]
    rows += [(100, rows[100][1], 0), (None, rows[7][1], 2), (350, rows[8][1], None), (400, rows[9][1], 3), (400, rows[9][1], 3)]
    return rows


def table(spark, rows: list[tuple]):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4, 5, 6, 7, 0.5, 8, "x", 9) for r in rows], DDL)


def finite(rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def filled(rows: list[tuple], unit: int = 1) -> list[list[float]]:
    width = -(-max((len(r[1]) for r in rows), default=0) // unit) * unit
    return [[*r[1], *[0.0] * (width - len(r[1]))] for r in rows]


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int, factor: int) -> list[tuple]:
    kept = sorted(finite(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(v * factor) if abs(v) < 2**50 else int(v) * factor for v in r] for r in filled(kept, parts)]
    width = len(x[0]) // parts if x else 0
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    assign = lambda p: [min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e)) for v in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            to = assign(p)
            for e in range(len(books[p])):
                if own := [v for v, k in zip(cut[p], to, strict=True) if k == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    to = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    error = [min(2**63 - 1, sum(far(cut[p][i], books[p][to[p][i]]) for p in range(parts))) for i in range(len(kept))]
    of_label: dict = {}
    for r, e in zip(kept, error, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    return [(r[0], "".join(f"{to[p][i]:02x}" for p in range(parts)), error[i], min(2**63 - 1, of_label[r[2]]), digest) for i, r in enumerate(kept)]


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e25])
def test_codes_of_odd_rows(spark, scale):
    rows = odd_vectors(scale)
    got = vafile.quantise(table(spark, rows), parts=2, entries=5, rounds=3, factor=64)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_codes(rows, 2, 5, 3, 64), key=repr)


def test_cells_leave_entries_out():
    rng = np.random.default_rng(1)
    q, entries = rng.integers(-4000, 4000, (500, 8)), rng.integers(-4000, 4000, (16, 8))
    index, error, refined = vafile.VaFile(entries, 3).nearest(q)
    all_of = ((q[:, None] - entries) ** 2).sum(axis=2)
    assert (index == all_of.argmin(axis=1)).all() and (error == all_of.min(axis=1)).all() and refined < 0.5 * all_of.size


def plain_nearest(rows: list[tuple], every: int, k: int) -> list[tuple]:
    kept = [(r[0], x) for r, x in zip(finite(rows), filled(finite(rows)), strict=True) if r[0] is not None and any(x)]
    out = []
    for i, q in kept:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in kept if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return out


def test_nearest_of_odd_rows(spark, monkeypatch):
    rows = odd_vectors()
    expected = sorted(plain_nearest(rows, 10, 7))
    for size in (16_384, 40):  # one cell, and many
        monkeypatch.setattr(nearest, "CANDIDATE_ROWS", size)
        monkeypatch.setattr(nearest, "QUERY_ROWS", size)
        assert sorted(map(tuple, nearest.search(table(spark, rows), 10, 7).collect())) == expected


def test_int8_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64)) * rng.lognormal(size=(3000, 1))
    heaps, recomputed = nearest.nearest_in((np.arange(100), x[:100]), (np.arange(3000), x), 20)
    exact = x[:100] @ x.T
    for i, heap in enumerate(heaps.of):
        assert [-j for _, j in sorted(heap, reverse=True)] == [j for j in np.argsort(-exact[i], kind="stable").tolist() if j != i][:20]
    assert recomputed < 0.05 * exact.size
    low, high = nearest.bounds(nearest.Quantised(x[:100]), slice(0, 100), nearest.Quantised(x), slice(0, 3000))
    assert (low <= exact).all() and (exact <= high).all()


def plain_negatives(rows: list[tuple], every: int, positives: int, negatives: int, low: int, high: int, factor: int) -> list[tuple]:
    kept = [(r[0], r[2], [math.floor(v * factor) for v in x]) for r, x in zip(finite(rows), filled(finite(rows)), strict=True) if r[0] is not None and r[2] is not None]
    out = []
    for i, label, a in kept:
        if i % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(a, c, strict=True)), j, other) for j, other, c in kept)
            for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
                inside = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:negatives]
                out += [(i, j, n, m, -p, -s) for n, (s, m, _) in enumerate(inside, 1)]
    return out


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    rows = odd_vectors()
    expected = sorted(plain_negatives(rows, 10, 4, 3, 40, 95, 16))
    assert expected
    for anchors, blocks in ((1024, 4096), (6, 30)):  # one cell, and many
        monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", anchors)
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(hard_negatives, "BLOCK_LEAF", 8)
        got = hard_negatives.mine(table(spark, rows), 10, 4, 3, 40, 95, 16)
        assert sorted(map(tuple, got.collect())) == expected


def test_trees_leave_pairs_out(spark):
    """Of tight groups, a fifth of the pairs is scored at most."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.05 for c in centres])
    rows = [(i, v.tolist(), int(i) % 3) for i, v in enumerate(x)]
    small = table(spark, rows)
    search = hard_negatives.Search(small, hard_negatives.F.col("vec_id") % 50 == 0, 256, "vec_id", "embedding", "label")
    assert search.tree.levels == 0
    t = search.rows.select("n", "vec_id", "label", "v").toArrow()
    side = lambda t, leaf: hard_negatives.Side(t, 16, 256, leaf)
    _, _, scored = hard_negatives.positives_in(side(t.filter((np.arange(len(t)) % 50 == 0).tolist()), 2), side(t, 32), 5)
    assert scored < 0.2 * 80 * 4000


@pytest.mark.parametrize("run", [lambda d: vafile.quantise(d), lambda d: nearest.search(d), lambda d: hard_negatives.mine(d)])
def test_empty_tables(spark, run):
    assert run(table(spark, odd_vectors()).limit(0)).count() == 0
    assert run(table(spark, [(50, None, 1), (0, [NAN], 2)])).count() == 0


def test_one_row(spark):
    one = table(spark, [(0, [1.0, 2.0], 1)])
    assert nearest.search(one).count() == 0 and hard_negatives.mine(one).count() == 0
    assert [r.error for r in vafile.quantise(one).collect()] == [0]
