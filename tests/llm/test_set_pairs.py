import random

from marginalia.llm import set_pairs as S


def brute(sets, t):
    out = set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = set(sets[a]), set(sets[b])
            if len(x & y) >= t * len(x | y) - 1e-12:
                out.add((a, b))
    return out


def test_pairs_against_brute_force_with_common_tokens_only(spark):
    """Few tokens for many sets: every pair needs the recursion, none has a rare token."""
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(24)]
    sets = {i: tuple(sorted(rng.sample(vocabulary, rng.randint(3, 8)))) for i in range(1200)}
    df = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "rid long, toks array<string>")
    members, classes = S.set_classes(df, 3)
    classes = S.persist_table(classes, "t")
    got = {(r.cid_a, r.cid_b) for r in S.similar_set_pairs(classes, 0.6, leaf=16).collect()}
    firsts = {}
    for i, s in sets.items():
        firsts.setdefault(s, i)
    want = brute({i: s for s, i in firsts.items()}, 0.6)
    assert got <= want
    assert len(got) >= 0.995 * len(want)


def test_copies_are_one_class_and_come_back_as_pairs(spark):
    rows = [(i, ["a", "b", "c"]) for i in range(5)] + [(9, ["a", "b", "c", "d"]), (10, ["x", "y"])]
    members, classes = S.set_classes(spark.createDataFrame(rows, "rid long, toks array<string>"), 3)
    classes = S.persist_table(classes, "t")
    pairs = S.similar_set_pairs(classes, 0.6)
    assert pairs.count() == 1
    assert S.record_pairs(members, pairs).count() == 10 + 5


def test_trees_reach_the_recall():
    for m in range(1, 9):
        assert (1 - S.survival(m)) ** S.trees_for(m, 0.999) <= 0.001 or S.survival(m) >= 1


def test_blocks_let_all_rows_meet(spark):
    rows = spark.createDataFrame([(1, 10, i, 3, 0, 0) for i in range(10)], "node long, n long, cid long, sz int, sig long, slack int")
    out = S._blocks(rows.withColumn("n", rows.n), 3).select("node", "cid")
    a = out.alias("a").join(out.alias("b"), "node").filter("a.cid < b.cid").select("a.cid", "b.cid").distinct()
    assert a.count() == 45


def test_one_large_set_does_not_grow_the_state_of_the_others(spark):
    """Trees are counted by a set's own size: sets of six tokens take part in as many beside one of 500 as without it."""
    df = spark.createDataFrame([(6,), (500,)], "sz int")
    alone = df.filter("sz = 6").select(S._trees_column(df.sz, 6, 0.999)).first()[0]
    six, large = [r[0] for r in df.select(S._trees_column(df.sz, 300, 0.999)).collect()]
    assert six == alone == S.trees_for(6, 0.999) and large == S.trees_for(300, 0.999)
    rows = [(i, [f"a{i % 40}"] + [f"t{(i * k) % 50}" for k in (3, 7, 11, 13, 17)]) for i in range(400)] + [(1000, [f"t{k}" for k in range(500)])]
    _, classes = S.set_classes(spark.createDataFrame(rows, "rid long, toks array<string>").selectExpr("rid", "array_sort(array_distinct(toks)) as toks"), 3)
    classes = S.persist_table(classes, "t")
    sets = {r.cid: tuple(r.toks) for r in classes.collect()}
    got = {(r.cid_a, r.cid_b) for r in S.similar_set_pairs(classes, 0.6, leaf=8).collect()}
    assert got <= brute(sets, 0.6) and len(got) >= 0.99 * len(brute(sets, 0.6))


def test_trees_alone_find_what_the_rare_tokens_find(spark):
    rng = random.Random(8)
    base = [tuple(sorted(rng.sample(range(3000), 7))) for _ in range(300)]
    sets = base + [tuple(sorted(set(b[1:]) | {rng.randrange(3000)})) for b in base]
    _, classes = S.set_classes(spark.createDataFrame([(i, [str(x) for x in t]) for i, t in enumerate(sets)], "rid long, toks array<string>").selectExpr("rid", "array_sort(toks) as toks"), 3)
    classes = S.persist_table(classes, "t")
    pairs = lambda rare: {(r.cid_a, r.cid_b) for r in S.similar_set_pairs(classes, 0.6, rare=rare).collect()}
    alone, whole = pairs(False), pairs(True)
    assert alone <= whole and len(alone) >= 0.99 * len(whole) and len(whole) >= 250


def test_hot_groups_are_expanded_in_chunks(spark):
    from marginalia.llm import expand as X

    members = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 100 + i) for i in range(3)] + [("one", 200)], "key string, rid long")
    rows, sizes = X.chunked(members, 8)
    got = [(r.r1, r.r2) for r in X.pairs_within(rows).collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2 + 3
    linked = spark.createDataFrame([("h", "c"), ("one", "h")], "key_a string, key_b string")
    got = [tuple(sorted(r)) for r in X.pairs_across(rows, sizes, linked).collect()]
    assert len(got) == len(set(got)) == 50 * 3 + 50
