import random

import numpy as np
import pytest

from marginalia.llm import near_duplicates as N
from marginalia.llm import vector_forest as V


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<float>")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((2500, 64))
    near = base[:500] + 0.25 * rng.standard_normal((500, 64))
    m = np.concatenate([base, near]).astype("f4")
    got = {(r.id, r.nbr) for r in V.nearest(vectors(spark, m), leaf=128).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i in range(len(m)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.88}
    assert got <= want
    assert len(got) >= 0.95 * len(want)


def test_hot_copies_give_bounded_lists_with_ties_by_id(spark):
    m = np.ones((400, 64), "f4")
    m[300:] = np.random.default_rng(1).standard_normal((100, 64))
    rows = V.nearest(vectors(spark, m)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.rank, r.nbr))
    assert [n for _, n in sorted(by[0])] == list(range(1, 11))
    assert [n for _, n in sorted(by[299])] == list(range(10))


def test_broken_vectors_match_nothing(spark):
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 32), (5, [float("nan")] * 64), (6, [1.0] * 64), (7, [2.0] * 64), (8, [None] * 64)]
    got = {(r.id, r.nbr) for r in V.nearest(spark.createDataFrame(rows, "id long, v array<float>")).collect()}
    assert got == {(6, 7), (7, 6)}


def test_leaves_cover_every_row_once():
    code = np.sort(np.random.default_rng(2).integers(0, 2**32, 5000))
    code[1000:3000] = code[1000]
    out = V.leaves(np.sort(code), 100)
    assert sorted(i for a, b, _, _ in out for i in range(a, b)) == list(range(5000))
    assert all(c <= a and b <= d for a, b, c, d in out)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [rng.sample(words, 40) for _ in range(300)]
    for t in texts[:100]:
        e = list(t)
        for k in rng.sample(range(40), rng.randint(1, 6)):
            e[k] = rng.choice(words)
        texts.append(e)
    df = spark.createDataFrame([(i, 1, " ".join(t)) for i, t in enumerate(texts)], "rid long, kind int, text string")
    _, links = N.similar_records(df, 0.7)
    got = {(r.a, r.b) for r in links.collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if set(texts[i]) != set(texts[j]) and len(set(texts[i]) & set(texts[j])) >= 0.7 * len(set(texts[i]) | set(texts[j]))}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_copies_order_and_case_make_one_class(spark):
    rows = [(1, 1, "One two, three four!"), (2, 1, "four THREE two one"), (3, 0, "one two three four"), (4, 1, None), (5, 1, " .. ")]
    g = {r.rid: (r.group_key, r.copies) for r in N.near_groups(spark.createDataFrame(rows, "rid long, kind int, text string")).collect()}
    assert g == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST", 8)
    base = [f"c{i}" for i in range(30)]
    rows = [(i, 1, " ".join(base + [f"x{i}", f"y{i}"])) for i in range(60)]
    g = N.near_groups(spark.createDataFrame(rows, "rid long, kind int, text string")).collect()
    assert {r.group_key for r in g} == {0}


def hot_group(rng, copies, others):
    """Different edits of one text of 46 words, and unrelated texts."""
    base, words = [f"c{i}" for i in range(46)], [f"w{i}" for i in range(5000)]
    texts = [base]
    for _ in range(copies):
        e = list(base)
        for k in rng.sample(range(46), rng.randint(2, 7)):
            e[k] = rng.choice(words)
        texts.append(e)
    return texts + [rng.sample(words, 46) for _ in range(others)]


def found_and_wanted(spark, texts):
    df = spark.createDataFrame([(i, 1, " ".join(t)) for i, t in enumerate(texts)], "rid long, kind int, text string")
    _, links = N.similar_records(df, 0.7)
    s = [set(t) for t in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] != s[j] and len(s[i] & s[j]) >= 0.7 * len(s[i] | s[j])}
    return {(r.a, r.b) for r in links.collect()}, want


@pytest.mark.parametrize("sent", [200_000, 0])
def test_long_lists_of_different_edits_are_compared_whole(spark, monkeypatch, sent):
    monkeypatch.setattr(N, "LIST", 16)
    monkeypatch.setattr(N, "BROADCAST_LISTS", sent)
    got, want = found_and_wanted(spark, hot_group(random.Random(9), 300, 600))
    assert got <= want and len(got) >= 0.85 * len(want)


def test_recall_in_a_dense_cluster(spark, monkeypatch):
    """A third of the rows in one cluster: every list is as by brute force, also where nodes are compared in blocks."""
    monkeypatch.setattr(V, "BLOCK", 2, raising=False)
    rng = np.random.default_rng(7)
    m = rng.standard_normal((6000, 64))
    m[:2000] = rng.standard_normal(64) + 0.25 * rng.standard_normal((2000, 64))
    m = m.astype("f4")
    got = {(r.id, r.nbr) for r in V.nearest(vectors(spark, m), leaf=64).collect()}
    u = m.astype("f8") / np.linalg.norm(m.astype("f8"), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, int(j)) for i in range(len(m)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.88}
    assert len(want) >= 15_000
    assert len(got & want) >= 0.98 * len(want)


def test_a_hot_group_keeps_its_links(spark):
    """Words that a group makes common don't change which pairs meet."""
    got, want = found_and_wanted(spark, hot_group(random.Random(9), 300, 0))
    assert got <= want and len(got) >= 0.995 * len(want)


def test_recall_of_runs_does_not_fall_with_the_size():
    for records in (10, 10**5, 10**7, 10**9):
        length = N.run_length(records)
        assert 1 - (1 - 0.7**length) ** N.runs_for(length, 0.7) >= 0.999


def test_links_where_all_words_are_common(spark):
    """A vocabulary so small that every word stands in most texts."""
    rng = random.Random(12)
    words = [f"c{i}" for i in range(48)]
    texts = [rng.sample(words, 36) for _ in range(250)]
    for t in texts[:100]:
        e = list(t)
        for k in rng.sample(range(36), rng.randint(1, 4)):
            e[k] = rng.choice(words)
        texts.append(e)
    got, want = found_and_wanted(spark, texts)
    assert got <= want and len(want) > 500 and len(got) >= 0.95 * len(want)


def test_waves_hold_every_tree_once():
    for trees in (1, 8, 9, 11, 49, 98):
        waves = V.waves_for(trees)
        assert [t for first, n in waves for t in range(first, first + n)] == list(range(trees)) and max(n for _, n in waves) <= V.WAVE


def test_work_grows_with_the_logarithm_of_the_rows():
    for rows in (10**5, 10**7, 10**9):
        depth = V.depth_for(rows)
        assert rows / 2**depth <= 4 * V.LEAF
        trees = V.trees_for(depth, 0.88, 0.99)
        assert 1 - (1 - (1 - np.arccos(0.88) / np.pi) ** depth) ** trees >= 0.99
