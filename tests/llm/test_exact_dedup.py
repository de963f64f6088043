import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm import exact_dedup as x

SCHEMA = "doc_id long, text string, kept string"


def brute(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


def test_chunks_combine():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3 * x.CHUNK + 17, dtype=np.uint8)
    p, b = x.PRIMES[0], x.BASES[0]
    h = 0
    for v in data.tolist():
        h = (h * b + v) % p
    assert x.fingerprint(data)[0] == h
    assert x.fingerprint(data[:0]) == (0, 0)


def test_groups_and_edges(spark):
    rows = [(1, "a  b", "z"), (2, "a\tb", None), (5, None, ""), (4, "", ""), (7, "é" * 50, ""), (8, "é" * 50 + " ", ""), (9, "x" * 4000, "")]
    rows += [(6, "x" * 4000, ""), (6, "x" * 4000, ""), (None, "solo", ""), (None, "a b", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for sizes in ({}, {"huge": 30, "piece": 7, "members_per_salt": 1}):
        got = x.assign(df, **sizes).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(tuple, got), key=str) == want
    kept = x.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8]
    assert x.assign(df.limit(0)).count() == 0


def test_equal_fingerprints_are_compared(spark):
    df = spark.createDataFrame([(1, "aa", ""), (2, "bb", ""), (3, "aa", "")], SCHEMA)
    prints = x.fingerprints(df).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(1).cast("long")})
    assert [r.doc_id for r in x.differing(df, prints).collect()] == [2]


def test_marks_never_miss(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 7)] + [(None,), (-5,), (2**63 - 1,)], "id long")
    rows = spark.createDataFrame([(i, "x") for i in range(3000)] + [(None, "x"), (-5, "x"), (2**63 - 1, "x")], "doc_id long, t string")
    want = {r.id for r in ids.collect()}
    for marks, most in ((x.MARKS, 5), (1 << 12, 2000), (64, 3003)):
        got = {r.doc_id for r in x.marked(rows, ids, marks=marks).where("__marked").collect()}
        assert want <= got and len(got - want) <= most
    none = x.marked(rows, ids.limit(0))
    assert none.columns == ["doc_id", "t", "__marked"] and none.where("NOT __marked").count() == 3003


def test_texts_of_their_own_are_not_shuffled(spark):
    """Without a broadcast of what goes, as on a large table, only copies are moved; the result is that of brute force."""
    import random

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    rng = random.Random(7)
    rows = [(i, "".join(map(chr, rng.choices(range(0x4E00, 0x9F00), k=4000))), "") for i in range(300)]
    rows += [(300 + i, rows[i][1], "") for i in range(5)] + [(299, rows[299][1], ""), (None, rows[7][1], ""), (None, "solo", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert sorted(map(tuple, x.assign(docs).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str) == brute(rows)
        assert sorted(str(r.doc_id) for r in x.keep_first(docs).collect()) == sorted([*map(str, range(300)), "None"])
        assert shuffled() - before < sum(len(t.encode()) for _, t, _ in rows) / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
