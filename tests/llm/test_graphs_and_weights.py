import math
import random

from marginalia.llm import forest as G
from marginalia.llm import grouped_split as P
from marginalia.llm import term_weight as W


def test_spanning_forest_of_random_graph(spark):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(300), 2))): rng.random() for _ in range(220)}
    edges |= {(1000 + i, 1001 + i): rng.random() for i in range(60)}  # a long chain
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u long, v long, w double")
    forest, comps = G.spanning_forest(df, "t")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    weight = 0.0
    for (a, b), w in sorted(edges.items(), key=lambda x: (x[1], x[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            weight += w
    got = {r.node: r.root for r in comps.collect()}
    assert len(got) == len({x for e in edges for x in e})
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in list(got)[:50])
    rows = forest.distinct().collect()
    assert len(rows) == len(got) - len(set(got.values()))
    assert math.isclose(sum(r.w for r in rows), weight, rel_tol=1e-9)


def test_star_edges_connect_a_hub(spark):
    links = spark.createDataFrame([(f"d{i}", "h") for i in range(500)] + [("d1", "g"), ("z", "g")], "node string, hub string")
    _, comps = G.spanning_forest(G.star_edges(links, 16), "t")
    assert comps.select("root").distinct().count() == 1 and comps.count() == 501


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(2)
    sizes = [(f"g{i}", rng.choice([1, 1, 1, 2, 3, 8])) for i in range(3000)] + [("huge", 3000)]
    df = spark.createDataFrame(sizes, "group_key string, size long")
    out = P.split_groups(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()
    assert len(out) == len(sizes) == len({r.group_key for r in out})
    total = sum(s for _, s in sizes)
    got = {}
    for r in out:
        got[r.split_name] = got.get(r.split_name, 0) + r["size"]
    assert abs(got["train"] / total - 0.8) < 0.01 and abs(got["test"] / total - 0.1) < 0.01
    assert next(r.split_name for r in out if r.group_key == "huge") == "train"


def test_author_names(spark):
    df = spark.createDataFrame([(" Ann  Lee1,*; ann lee†;Unknown ; et al.;N/A; Bo Ek",)], "a string")
    assert df.select(P.author_names(df.a)).first()[0] == ["ann lee", "bo ek"]


def test_log_entropy_bounds(spark):
    rows = [(d, "everywhere", 2.0) for d in range(8)] + [(3, "once", 5.0), (1, "twice", 1.0), (2, "twice", 1.0), (None, "once", 1.0)]
    w = {r.term: r.weight for r in W.log_entropy(spark.createDataFrame(rows, "doc long, term string, tf double"), "doc", "term", "tf").collect()}
    assert abs(w["everywhere"]) < 1e-12 and w["once"] == 1.0
    assert math.isclose(w["twice"], 1 - math.log(2) / math.log(8))
