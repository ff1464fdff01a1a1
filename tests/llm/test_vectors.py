import numpy as np
import pytest

from origintrace.llm import cover_tree, posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int, score double, id int"


def brute(ids, points, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (points[q] * points).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def table(spark, ids, points):
    return spark.createDataFrame([(int(i), [float(x) for x in p], 0, 1.0, 2) for i, p in zip(ids, points)], SCHEMA)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:300] = x[100]  # one vector many times
    x[300:400] = x[100] + rng.normal(size=(100, 8)).astype(np.float32) * 1e-3
    return np.arange(700), x


def test_cover_tree_equals_brute_force(spark, points):
    ids, x = points
    assert collected(cover_tree.search(table(spark, ids, x))) == {
        q: [(i, int(s)) for i, s in r] for q, r in brute(ids, np.floor(256 * x.astype(np.float64)), 50, 5).items()
    }


def test_cover_tree_covers_and_partitions(points):
    tree = cover_tree.CoverTree(points[0], points[1].astype(np.float64))
    assert sorted(tree.perm) == list(range(len(points[0])))
    for n in range(len(tree.centre)):
        inside = tree.points[tree.perm[tree.start[n] : tree.stop[n]]]
        assert np.linalg.norm(inside - tree.points[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9


def test_posting_lists_reach_their_recall(spark, points):
    ids, x = points
    found, want = collected(posting_lists.search(table(spark, ids, x))), brute(ids, x.astype(np.float64), 20, 20)
    assert found.keys() == want.keys() and all(len(r) == 20 for r in found.values())
    share = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(share) >= 0.9
    lookup = dict(zip(ids.tolist(), x.astype(np.float64)))
    for q, r in found.items():
        assert [s for _, s in r] == sorted((s for _, s in r), reverse=True)
        for i, s in r:
            assert s == pytest.approx(float(lookup[q] @ lookup[i]), abs=1e-12)
        assert all(a < b for (a, s), (b, t) in zip(r, r[1:]) if s == t)


def test_posting_lists_lose_no_neighbour_to_repeated_rows(spark):
    rng = np.random.default_rng(5)
    ids, x = np.arange(80), rng.normal(size=(80, 4)).astype(np.float32)
    copies = np.concatenate([ids, np.repeat(np.arange(1, 61, 6), 30)])
    found, want = collected(posting_lists.search(table(spark, copies, x[copies]))), brute(ids, x.astype(np.float64), 20, 20)
    assert {q: [i for i, _ in r] for q, r in found.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    # other vectors of one id are rows of their own, also with equal scores
    rows = [(0, [1.0, 0.0])] + [(1, [0.5, j / 64]) for j in range(25)] + [(i, [0.25, i]) for i in range(2, 12)]
    found = collected(posting_lists.search(table(spark, *zip(*rows)), k=30))[0]
    assert found == [(1, 0.5)] * 25 + [(i, 0.25) for i in range(2, 7)]


@pytest.mark.parametrize("own", [4096, 30])
def test_posting_lists_take_vectors_of_every_length(spark, own, monkeypatch):
    """Whether a length has lists of its own or is compared whole; few lists, so that the search is exact."""
    monkeypatch.setattr(posting_lists, "OWN_LISTS", own)
    monkeypatch.setattr(posting_lists, "ASKED", 2)
    rng = np.random.default_rng(8)
    by_length = {4: np.arange(0, 60), 3: np.arange(60, 100), 1: np.array([100, 101, 120])}
    points = {n: rng.normal(size=(len(ids), n)).astype(np.float32) for n, ids in by_length.items()}
    rows = [(int(i), [float(c) for c in p], 0, 1.0, 2) for n, ids in by_length.items() for i, p in zip(ids, points[n])]
    found = collected(posting_lists.search(spark.createDataFrame(rows, SCHEMA)))
    want = {}
    for n, ids in by_length.items():
        want |= brute(ids, points[n].astype(np.float64), 20, 20)
    assert {0, 20, 40, 60, 80, 100, 120} == set(want)
    assert {q: [i for i, _ in r] for q, r in found.items()} == {q: [i for i, _ in r] for q, r in want.items()}


@pytest.mark.parametrize("search, every", [(cover_tree.search, 50), (posting_lists.search, 20)])
def test_odd_vectors(spark, search, every):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]),
            (None, [1.0, 1.0]), (7, [-3.0, 0.5]), (100, [2.0, 0.0]), (100, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    got = collected(search(df, k=3, every=every))
    assert set(got) == {0, 100}
    assert {i for i, _ in got[0]} <= {1, 7, 100} and [i for i, _ in got[0]][0] == 1
    assert search(df.limit(0), k=3, every=every).collect() == []
    assert search(df.where("vec_id = 0"), k=3, every=every).collect() == []
