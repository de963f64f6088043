import random
import re

import pytest

from quire.llm import components
from quire.llm import near_dedup as nd


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """doc_id -> (set size, component), by comparing all pairs of exact shingle sets."""
    sets = {}
    for i, t in rows:
        w = words(t)
        s = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[a + 1 :]:
            if min(len(s), len(t)) * 4 >= 3 * max(len(s), len(t)) and 100 * (k := len(s & t)) >= 75 * (len(s) + len(t) - k):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}, sets


def texts(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocab) for _ in range(rng.randrange(1, 160))] for _ in range(25)]
    common = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(400):
        base = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(vocab)
        if rng.random() < 0.3:
            base += common
        rows.append((i * 7 % 1001, rng.choice([" ", "\n", "  "]).join(base).replace("w1", rng.choice(["w1", "W1"]))))
    return rows + [(5001, ""), (5002, None), (5003, " \t"), (5004, "one two"), (5005, "One  TWO"), (5006, "Één twee"), (5007, "één twee"), (7, "a" * 20_000), (7, "b c")]


@pytest.mark.parametrize("tiles", [{}, {"table_tile": 5, "cluster_tile": 7}])
def test_same_as_all_pairs(spark, tiles):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    want, sets = brute(rows)
    got = nd.assign(df, **tiles).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id], r
        assert r.n_shingles in map(len, sets[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)
    assert len({r.component_id for r in got}) < len(rows)


def test_same_as_all_pairs_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in df.collect()])
    got = nd.assign(df)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, nd.assign(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (None, 0, None, True), (None, 2, None, True)]
    assert nd.assign(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(5, 5), (None, 3)]
    edges += [(2000, i) for i in range(2001, 2300)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_copies_of_members_do_not_grow_with_the_square_of_a_cluster(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    far = [f"y{j}" for j in range(45)]
    rows += [(1000 + i, " ".join(base[:155] + far[: 45 - i] + [f"z{i}{j}" for j in range(i)])) for i in range(3)]
    dealt, seen = nd._dealt, []

    def counted(cells):
        seen.append(cells.count())
        return dealt(cells)

    monkeypatch.setattr(nd, "_dealt", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = nd.describe(df).withColumnRenamed("doc_id", "id")
    one = classes.selectExpr("id AS node", "0L AS root")
    links = nd.verified_edges(df, classes, one, tile=25)
    found = {r.node: r.root for r in components.connected_components(links).collect()}
    want, _ = brute(rows)
    assert {i: found.get(i, i) for i in want} == want
    tiles = 17
    assert sum(seen) < 3 * len(rows) + nd.PIVOTS * tiles < len(rows) * tiles / 4
