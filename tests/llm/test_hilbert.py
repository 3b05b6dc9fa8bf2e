import numpy as np

from intentlake.llm import hilbert


def test_curve_visits_every_cell_by_steps_of_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = np.arange(1 << bits)
        grid = np.array(np.meshgrid(*[side] * dims)).reshape(dims, -1).T
        key = hilbert.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def clustered(n, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 8, 64))
    v = centres[r.integers(0, len(centres), n)] + 0.4 * r.standard_normal((n, 64))
    return v.astype(np.float32)


def neighbours(ids, v, k):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -3)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def run(spark, ids, v, k=5, **options):
    rows = [(int(i), None if x is None else [float(y) for y in x], "code") for i, x in zip(ids, v)]
    df = spark.createDataFrame(rows, "unit_id long, vector array<float>, code string")
    out = {}
    for r in sorted(hilbert.nearest(df, "unit_id", "vector", k, **options).collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.other)
    return out


def test_small_collections_are_exact(spark):
    v = clustered(300)
    ids = np.arange(300) * 3
    assert run(spark, ids, v) == neighbours(ids, v, 5)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK", 128)
    v = clustered(6000, 1)
    ids = np.arange(6000)
    want, got = neighbours(ids, v, 5), run(spark, ids, v, partition_rows=4000)
    recall = np.mean([len(set(want[i]) & set(got.get(i, []))) / 5 for i in want])
    assert recall >= 0.9


def test_copies_and_unusable_rows(spark):
    v = list(clustered(40, 2))
    v += [v[0]] * 9 + [v[1] * 4] * 2
    v += [None, [0.0] * 64, [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, []]
    got = run(spark, range(len(v)), v)
    usable = np.array(v[:51], np.float32)
    want = neighbours(np.arange(51), usable, 5)
    assert set(got) == set(range(51))
    for i in range(51):
        if i not in (1, 49, 50):
            assert got[i] == want[i], i
        else:
            assert set(got[i]) == set(want[i])


def test_few_and_no_rows(spark):
    v = clustered(16, 3)[:3]
    assert {i: sorted(x) for i, x in run(spark, range(3), v).items()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert run(spark, [5], v[:1]) == {}
    assert run(spark, [5], [None]) == {}


def test_few_dimensions(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((200, 3)).astype(np.float32)
    ids = np.arange(200)
    assert run(spark, ids, v, 4, dim=3) == neighbours(ids, v, 4)


def test_parts_refine_the_coarse_key():
    r = np.random.default_rng(6)
    fine = r.integers(0, 1 << 9, (2000, 4))
    parts = hilbert.hilbert_parts(fine, 3, 3)
    assert (parts[0] == hilbert.hilbert_key(fine >> 6, 3)).all()
    assert ((parts[0] << 24 | parts[1] << 12 | parts[2]) == hilbert.hilbert_key(fine, 9)).all()


def test_recall_in_a_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK", 64)
    r = np.random.default_rng(7)
    n, ids = 6000, np.arange(6000)
    for cosine in (0.9999, 0.999999):
        v = clustered(n, 8).astype(np.float64)
        group = r.permutation(n)[: n // 3]
        residual = clustered(len(group), 9).astype(np.float64)
        residual /= np.linalg.norm(residual, axis=1)[:, None]
        centre = r.standard_normal(64)
        v[group] = centre / np.linalg.norm(centre) + np.sqrt(1 / cosine**2 - 1) * residual
        # Lengths differ, which is nothing to a direction.
        v = (v * r.uniform(0.1, 10, n)[:, None]).astype(np.float32)
        want, got = neighbours(ids, v, 5), run(spark, ids, v, partition_rows=8000)
        recall = np.mean([len(set(want[i]) & set(got.get(i, []))) / 5 for i in group])
        assert recall >= 0.85, (cosine, recall)


def test_rescaled_copies_fill_a_third(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK", 64)
    r = np.random.default_rng(10)
    n, ids = 3000, np.arange(3000)
    v = clustered(n, 11)
    group = r.permutation(n)[: n // 3]
    v[group] = v[group[0]] * r.uniform(0.1, 10, len(group)).astype(np.float32)[:, None]
    got, copies = run(spark, ids, v), set(group.tolist())
    assert all(len(got[i]) == 5 and copies.issuperset(got[i]) for i in copies)


def test_exact_way(spark):
    v = list(clustered(200, 12)) + [None]
    assert run(spark, range(201), v, exact=True) == neighbours(np.arange(200), np.array(v[:200]), 5)


def test_windows_and_orderings_grow():
    assert hilbert.block_for(100) == hilbert.BLOCK and hilbert.block_for(4_000_000) == 6000
    assert [hilbert.orderings_for(n) for n in (0, 200_000, 200_001, 800_000, 12_800_000)] == [5, 5, 6, 6, 8]


def test_codes_keep_directions():
    r = np.random.default_rng(13)
    unit = r.standard_normal((50, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    import pyarrow as pa

    back = hilbert.unpack(pa.array([bytes(x) for x in hilbert.pack(unit)], pa.binary()), 64)
    assert (np.abs((back * unit).sum(axis=1) - 1) < 1e-9).all()
    h = hilbert.fingerprints(np.concatenate([unit, unit[:3] + 1e-6]))
    assert len(set(map(tuple, h.T.tolist()))) == 53
