import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quire.llm import topk

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step, k):
    import numpy as np

    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % step == 0}):
        vectors = {tuple(v) for i, v in ok if i == q}
        found = sorted((-sum(a * b for a, b in zip(v, c)), i) for v in vectors for i, c in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def check(spark, rows, k=4, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, k)


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([24, 24, 24, 9]))], 0) for i in range(90)]
    rows += [(3, rows[3][1], 0), (200, rows[7][1], 0), (201, rows[7][1], 0), (300, None, 1), (301, [], 1), (302, [1.0, None], 1), (303, [float("nan")], 1), (305, [float("inf")], 1), (None, [1.0], 1)]
    check(spark, rows)
    check(spark, rows, first=20, growth=2)
    check(spark, rows, query_bytes=1500, first=10, growth=4)


def plain(ids, c, own, q, k):
    import numpy as np

    out = []
    for i, s in zip(own, q.T @ c):
        s = np.where(ids == i, -np.inf, s)
        few = np.flatnonzero(s >= np.partition(s, -k)[-k])
        out += [(int(i), int(ids[j]), int(s[j])) for j in few[np.lexsort((ids[few], -s[few]))][:k]]
    return out


def searched(ids, c, own, q, k, kind, least=None):
    import numpy as np

    found = topk.Search(own, q, k, least, kind)
    for at in range(0, len(ids), topk.TILE):
        found.add(ids[at : at + topk.TILE], np.ascontiguousarray(c[:, at : at + topk.TILE]))
    return found


def unit_vectors(n, decay=0.0):
    import numpy as np

    c = np.random.default_rng(2).normal(size=(64, n)) / (1 + np.arange(64))[:, None] ** decay
    return np.floor(1024 * c / np.linalg.norm(c, axis=0))


def test_bounds_prune_without_loss():
    import numpy as np

    c = unit_vectors(30_000) * np.linspace(1, 0.05, 64).round(2)[:, None]
    c = np.floor(c)
    c[:, 5000:15_000] = c[:, [77]]  # a third of the rows is one vector
    ids, own = np.arange(30_000), np.arange(0, 30_000, 100)
    q = np.ascontiguousarray(c[:, own])
    want = plain(ids, c, own, q, 10)
    found = searched(ids, c, own, q, 10, np.float32)
    assert list(zip(*(x.to_pylist() for x in found.found().columns))) == want
    assert list(zip(*(x.to_pylist() for x in searched(ids, c, own, q, 10, np.float64).found().columns))) == want
    assert found.compactions > 50 and found.products < 0.85 * len(own) * c.size
    # Thresholds known beforehand only take rows away that do not reach them.
    least = np.full(len(own), 200_000.0)
    few = list(zip(*(x.to_pylist() for x in searched(ids, c, own, q, 10, np.float32, least).found().columns)))
    assert few == [x for x in want if x[2] >= 200_000]
    assert 0 < len(few) < len(want)


def test_not_slower_than_the_plain_product():
    """On one core, as a task has it, and on vectors whose mass lies in their first dimensions."""
    code = """
import time
import numpy as np
from tests.llm.test_topk import plain, searched, unit_vectors
c = unit_vectors(50_000, 0.5)
ids, own = np.arange(50_000), np.arange(0, 50_000, 100)
q = np.ascontiguousarray(c[:, own])
took = [[], []]
for _ in range(3):
    for work, times in ((lambda: plain(ids, c, own, q, 10), took[0]), (lambda: searched(ids, c, own, q, 10, np.float32), took[1])):
        at = time.process_time()
        found = work()
        times.append(time.process_time() - at)
assert found.compactions > 100 and found.products < 0.7 * len(own) * c.size
print(min(took[1]) / min(took[0]))
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": ROOT})
    assert float(run.stdout) < 1.3, run.stderr  # 0.6 to 0.95 alone; other work on the machine blurs it


def test_large_values_few_rows_and_empty(spark):
    check(spark, [(0, [1e5, -2.5], 0), (5, [3e4], 0), (6, [-1e5, 1e3], 0), (7, [1e7, 1.0, 9.0], 0)], k=10)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0
    check(spark, [(0, [1.0], 0)])
    beyond = topk.top_k(spark.createDataFrame([(0, [1e12], 0), (1, [1e12], 0)], SCHEMA), F.col("vec_id") % 5 == 0)
    with pytest.raises(Exception, match="beyond the range of a long"):
        beyond.collect()


def test_clashing_names(spark):
    rows = [(i, [float(i), 1.0], "x", 3, [2.0], 4) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, rank int, v array<double>, score int")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, 2)
    assert sorted(map(tuple, got.collect())) == brute([r[:3] for r in rows], 5, 2)


def test_what_is_shuffled_grows_with_rows_not_with_tasks(spark):
    """Rows that a search with a seeded threshold hands on, against k for each query and task."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)], 0) for i in range(8000)], SCHEMA).repartition(64)
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    block = rows.where("id % 100 = 0").toArrow()
    ids, vectors = block["id"].to_numpy(), topk.vertical(block["v"].combine_chunks())
    few = topk._answer(rows.where("pmod(xxhash64(id), 8) = 0"), block, [1], 10).where("rank = 10").toArrow()
    known = dict(zip(few["query_id"].to_pylist(), few["score"].to_pylist()))
    import numpy as np

    least = np.array([known[i] for i in ids.tolist()])
    count = lambda bound: rows.mapInArrow(topk._search(spark.sparkContext.broadcast((ids, vectors, bound)), 10), "query_id long, vec_id long, score long").count()
    assert count(None) == 64 * 10 * len(ids) and count(least) < 2 * 8 * 10 * len(ids)
