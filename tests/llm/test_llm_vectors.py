"""The two operators on vectors against brute force."""

from __future__ import annotations

import numpy as np

from tarnwood.llm import binary_codes, cross_polytope

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r], 0) for i, r in enumerate(x)], SCHEMA)


def clustered(n=300, d=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    for i in range(0, n - 1, 5):
        base[i + 1] = base[i] + rng.standard_normal(d) * 0.08
    base[7] = base[6]
    return base.astype(np.float32).astype(float)


def test_code_groups_equal_brute_force(spark):
    x = clustered()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(np.triu(s >= 0.95 - 1e-12, 1))):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    paired = {i for i in range(len(x)) if (s[i] >= 0.95 - 1e-12).sum() > 1}
    want = {i: root[i] for i in paired}
    got = {r["vec_id"]: r["keep_id"] for r in binary_codes.near_groups(frame(spark, x)).collect()}
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want)


def test_estimates_lie_within_their_bounds():
    x = clustered(200)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    turns = binary_codes.rotations(32, 3)
    y, sign, factor = binary_codes.code(u, turns)
    est, bound = binary_codes.estimate(y, sign, factor)
    assert (np.abs(est - u @ u.T) <= bound + 1e-9).mean() > 0.999
    means = []
    for seed in range(60):
        y, sign, factor = binary_codes.code(u[:20], binary_codes.rotations(32, 1, seed))
        means.append(binary_codes.estimate(y, sign, factor)[0])
    assert np.abs(np.mean(means, 0) - u[:20] @ u[:20].T).mean() < 0.03


def test_pairs_at_the_threshold_meet_at_every_size():
    rng = np.random.default_rng(4)
    d, t = 64, 0.95
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 1500, d)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = t * a + np.sqrt(1 - t * t) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (300, 10**6, 10**8):
        *shape, many = binary_codes.plan(n, d)
        turns = binary_codes.rotations(d, many)
        x, y = (binary_codes.band_keys(binary_codes.code(v, turns)[1], *shape) for v in (a, b))
        assert (x == y).any(1).mean() >= 0.9


def awkward(spark):
    nan, inf = float("nan"), float("inf")
    return spark.createDataFrame(
        [(1, [1.0, 0.0], 0, 1.0), (2, [1.0, 0.0], 0, 1.0), (2, [1.0, 0.0], 0, 1.0), (3, None, 0, 1.0), (4, [], 0, 1.0), (5, [nan, 1.0], 0, 1.0), (6, [inf, 1.0], 0, 1.0), (7, [0.0, 0.0], 0, 1.0), (8, [None, 1.0], 0, 1.0), (None, [1.0, 0.0], 0, 1.0), (9, [1.0, 0.0, 0.0], 0, 1.0), (10, [0.0, 1.0], None, None)],
        "vec_id long, embedding array<double>, d int, v double",
    )


def test_groups_of_awkward_rows(spark):
    got = {r["vec_id"]: r["keep_id"] for r in binary_codes.near_groups(awkward(spark)).collect()}
    assert got == {1: 1, 2: 1}
    assert binary_codes.near_groups(awkward(spark).limit(0)).count() == 0


def test_recall_of_neighbours(spark):
    x = clustered(600, 24, 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i], kind="stable")[:10].tolist()) for i in range(len(x))}
    rows = cross_polytope.neighbours(frame(spark, x)).collect()
    hits = sum(r["neighbour_id"] in want[r["vec_id"]] for r in rows)
    assert hits / (10 * len(x)) >= 0.9
    assert all(abs(r["similarity"] - s[r["vec_id"], r["neighbour_id"]]) < 1e-6 for r in rows[:500])
    assert {r["vec_id"] for r in rows} == set(range(len(x)))


def test_probes_are_the_nearest_buckets():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20, 24))
    assert cross_polytope.widths(10**5, 24)[1] == 0 and cross_polytope.widths(10**6, 24) == (32, 4)
    for shape in ((32, 0), (32, 4)):
        one = cross_polytope.signed(x, 1, 0, 32)
        s = one if not shape[1] else (one[:, :, None] + cross_polytope.signed(x, 1, 1, 4)[:, None, :]).reshape(20, -1)
        got = cross_polytope.probed(x, 1, shape, 17)
        assert (got[:, :0].shape[0] == 20) and (cross_polytope.bucket(x, 1, shape) == s.argmax(1)).all()
        assert [set(r) for r in got.tolist()] == [set(np.argsort(-r)[:17].tolist()) for r in s]
        y = x + rng.standard_normal(x.shape) * 0.3
        own = np.stack([s[np.arange(20), cross_polytope.bucket(y, 1, shape)]])[0]
        assert cross_polytope.probes_needed(x, y, 2, shape).max() >= 1
        assert ((s >= own[:, None] - 1e-12).sum(1) >= cross_polytope.probes_needed(x, y, 2, shape)).all()


def test_blocks_and_second_rotation_lose_nothing(spark, monkeypatch):
    x = clustered(400, 24, 5)
    for name, value in (("LOAD", 4), ("CELL", 50), ("QUERIES", 5)):
        monkeypatch.setattr(cross_polytope, name, value)
    monkeypatch.setattr(cross_polytope, "widths", lambda n, d: (32, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    rows = cross_polytope.neighbours(frame(spark, x), every=3).collect()
    assert {r["vec_id"] for r in rows} == set(range(0, 400, 3))
    want = {i: set(np.argsort(-s[i], kind="stable")[:10].tolist()) for i in range(0, 400, 3)}
    assert sum(r["neighbour_id"] in want[r["vec_id"]] for r in rows) / (10 * len(want)) >= 0.9


def test_of_many_equal_neighbours_the_least_ids_are_given(spark):
    rng = np.random.default_rng(8)
    x = np.r_[np.tile(rng.standard_normal(24), (60, 1)), rng.standard_normal((60, 24))]
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x)], SCHEMA)
    copies = sorted(ids[:60].tolist())
    got = {}
    for r in cross_polytope.neighbours(df).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour_id"]
    for i in copies:
        assert [got[i][k] for k in range(1, 11)] == [c for c in copies if c != i][:10]
    s = np.array([[1.0, 3.0, 2.0, 2.0, 2.0]])
    assert cross_polytope.nearest(s, 3)[1].tolist() == [1, 2, 3] and cross_polytope.nearest(s, 9)[1].tolist() == [0, 1, 2, 3, 4]


def test_neighbours_of_awkward_rows(spark):
    got = sorted((r["vec_id"], r["rank"], r["neighbour_id"]) for r in cross_polytope.neighbours(awkward(spark)).collect())
    assert got == [(1, 1, 2), (1, 2, 10), (2, 1, 1), (2, 2, 10), (10, 1, 1), (10, 2, 2)]
    assert cross_polytope.neighbours(awkward(spark).limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)
