"""Exact top-k search by columnar branch and bound over integer vectors.

Candidates lie in vertical layout: one run of memory per dimension, in tiles of ``TILE``.  Inner products grow by blocks of
dimensions; what a candidate's product can still gain is at most ``|rest of query| * |rest of candidate|`` (its remaining
mass; the masses of a tile are computed once).  The k-th best score that a query has seen so far, carried from tile to tile,
is its threshold, and pairs whose bound is below it are compacted away.  The blocks before the first at which a few columns
show that most pairs will go are added as one product for a group of queries; from there on only surviving pairs are read.

Candidates stay where the scan reads them.  Queries go past them in blocks of ``QUERY_BYTES`` at most, each sent to all tasks,
and a task returns at most k candidates a query.  So that this does not grow with the number of tasks either, a seeded share
of the rows is searched first: its k-th best score is a threshold that later rows have to reach, and a query is
answered by about ``k * GROWTH`` rows at each size, whatever the number of tasks.  What is shuffled grows in
proportion to the rows; the products grow with rows times queries, as the question does.

Defined results
  * a component x counts as floor(1024 * x) with x as double; scores are exact integers; one beyond the range of a long is
    an error, never another number;
  * vectors that are null, empty, or hold a null or non-finite component take no part, on either side, nor does a null id;
  * of two vectors of different length, the shorter counts as continued by zeros;
  * rows with the query's id are not its candidates, all others are, repeated rows each for themselves; a repeated query row
    is searched once for each of its distinct vectors and the best k of all are kept;
  * equal scores: smaller vec_id first; fewer than k candidates: all; an empty table: no rows; further columns are ignored,
    whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import hold, materialise, new_path, read, small_batches

K = 10
SCALE = 1024
DIMENSIONS = 8
#: Candidates of a tile, and queries of a group that meets it at once.
TILE, GROUP = 2048, 64
#: Pairs are compacted once at most this share of them survives, as judged by ``PROBE`` columns of a tile: reading a pair on
#: its own costs many times what it costs within a product.
DENSE, PROBE = 1 / 12, 48
#: Bytes of the queries that are sent to the tasks at once.
QUERY_BYTES = 32 << 20
#: Rows that are searched without a threshold, and how much larger each later share of the rows is.
FIRST, GROWTH = 1 << 16, 64
#: Up to these whole numbers are exact in floats of four and of eight bytes.
EXACT = {np.float32: 2**24, np.float64: 2**53}
LONG = 2**63 - 1


def usable(column: str) -> Column:
    """Neither null nor empty, and every component finite."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~odd


def vertical(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """floor(``SCALE`` * x) of lists of doubles: a row per dimension, filled up with zeros to ``width`` at least."""
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False))
    sizes = np.diff(vectors.offsets.to_numpy())
    n, widest = len(vectors), int(sizes.max(initial=0))
    if n and widest >= width and (sizes == widest).all():
        return np.ascontiguousarray(flat.reshape(n, widest).T)
    out = np.zeros((max(width, widest), n))
    owner = np.repeat(np.arange(n), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = flat
    return out


def masses(rows: np.ndarray, blocks: int) -> np.ndarray:
    """The length of what is left of each vector before each block of dimensions, and after the last."""
    out = np.zeros((blocks + 1, rows.shape[1]))
    squares = np.square(rows, dtype=np.float64)
    for b in range(blocks - 1, -1, -1):
        out[b] = out[b + 1] + squares[b * DIMENSIONS : (b + 1) * DIMENSIONS].sum(0)
    return np.sqrt(out)


class Search:
    """The best candidates so far of a block of queries; ``vectors`` has a row per dimension, ``least`` the scores that have to
    be reached.  All values are whole, and no sum within a product of two vectors is beyond ``EXACT`` of the type."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None, kind: type = np.float64):
        n = len(ids)
        self.ids, self.k, self.kind = ids, k, kind
        self.blocks = -(-len(vectors) // DIMENSIONS)
        self.rows = np.ascontiguousarray(vectors.T, kind)
        self.mass = np.ascontiguousarray(self._slack(masses(vectors, self.blocks)).T, kind)
        self.threshold = np.full(n, -np.inf) if least is None else least.astype(np.float64)
        # Of candidates at the threshold, only those with smaller ids are better than what is there.
        self.last = np.full(n, LONG)
        none = np.zeros(0, np.int64)
        # For each group of queries: a query's place in it, candidate, score.
        self.best = [(none, none, np.zeros(0)) for _ in range(0, n, GROUP)]
        self.cuts, self.tiles = [self.blocks] * len(self.best), 0
        self.compactions = self.products = 0

    def add(self, ids: np.ndarray, tile: np.ndarray) -> None:
        """Searches a tile of candidates."""
        tile = tile.astype(self.kind, copy=False)
        mass = masses(tile, self.blocks).astype(self.kind)
        self.tiles += 1
        for g in range(len(self.best)):
            q, c, score = self._survivors(g, ids, tile, mass)
            at, found = q + g * GROUP, ids[c]
            better = (self.ids[at] != found) & ((score > self.threshold[at]) | (found <= self.last[at]))
            self._keep(g, q[better], found[better], score[better].astype(np.float64))

    def _survivors(self, g: int, ids: np.ndarray, tile: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries' places in their group, candidates' places and scores of the pairs that reach the queries' thresholds."""
        own = slice(g * GROUP, (g + 1) * GROUP)
        rows, left, least = self.rows[own], self.mass[own], self.threshold[own].astype(self.kind)
        if self.tiles & (self.tiles - 1) == 0:
            self.cuts[g] = self._first_cut(rows, left, least, tile, mass)
        at = self.cuts[g]
        done = at * DIMENSIONS
        score = rows[:, :done] @ tile[:done]
        self.products += score.size * min(done, len(tile))
        if at == self.blocks and np.isneginf(least).any() and len(ids) > self.k:
            score[self.ids[own][:, None] == ids] = -np.inf
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        # First by the largest mass of the tile, which takes one pass over the pairs, then by each candidate's own.
        reach = least - left[:, at] * mass[at].max()
        q, c = np.divmod(np.flatnonzero((score >= reach[:, None]).ravel()), tile.shape[1])
        score = score[q, c]
        if at < self.blocks:
            alive = np.flatnonzero(score + left[q, at] * mass[at][c] >= least[q])
            q, c, score = q[alive], c[alive], score[alive]
        for block in range(at, self.blocks):
            self.compactions += 1
            part = slice(block * DIMENSIONS, (block + 1) * DIMENSIONS)
            score = score + np.einsum("ij,ji->i", rows[q, part], tile[part, c])
            self.products += len(q) * DIMENSIONS
            alive = np.flatnonzero(score + left[q, block + 1] * mass[block + 1][c] >= least[q] if block + 1 < self.blocks else score >= least[q])
            q, c, score = q[alive], c[alive], score[alive]
        return q, c, score

    def _first_cut(self, rows: np.ndarray, left: np.ndarray, least: np.ndarray, tile: np.ndarray, mass: np.ndarray) -> int:
        """The block before which to compact, by what the bounds do to a few columns; the result does not depend on it."""
        if not np.isfinite(least).all():
            return self.blocks
        some = slice(None, None, max(1, tile.shape[1] // PROBE))
        columns = np.ascontiguousarray(tile[:, some])
        probe = np.zeros((len(rows), columns.shape[1]), self.kind)
        for block in range(1, self.blocks):
            part = slice((block - 1) * DIMENSIONS, block * DIMENSIONS)
            probe += rows[:, part] @ columns[part]
            if (probe >= (least - left[:, block] * mass[block].max())[:, None]).mean() <= DENSE:
                return block
        return self.blocks

    @staticmethod
    def _slack(mass: np.ndarray) -> np.ndarray:
        """A little more than the remaining mass, so that rounding never prunes: the bound errs by a few units of the last place."""
        return mass * (1 + 1e-5) + 1e-3

    def _keep(self, g: int, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = (np.concatenate(x) for x in zip(self.best[g], (q, ids, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = _ranks(q)
        kept = rank < self.k
        self.best[g] = q[kept], ids[kept], score[kept]
        last = rank == self.k - 1
        own = q[last] + g * GROUP
        at_least = score[last] >= self.threshold[own]
        self.threshold[own[at_least]], self.last[own[at_least]] = score[last][at_least], ids[last][at_least]

    def found(self) -> pa.RecordBatch:
        places = [q + g * GROUP for g, (q, _, _) in enumerate(self.best)]
        q, ids, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, [b[1] for b in self.best], [b[2] for b in self.best]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], pa.int64()), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal keys."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_keys)]))


def exact_wide(ids: np.ndarray, tile: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray | None, k: int) -> list[tuple[int, int, int]]:
    """The best of a tile for values too large for exact doubles, in whole numbers of any size."""
    out = []
    columns = [[int(x) for x in column] for column in tile.T]
    for i, vector in enumerate(queries.T):
        whole = [int(x) for x in vector]
        scored = sorted((-sum(a * b for a, b in zip(whole, c)), int(d)) for c, d in zip(columns, ids) if d != own[i])[:k]
        out += [(int(own[i]), d, -s) for s, d in scored if least is None or -s >= least[i]]
    if any(not -LONG - 1 <= s <= LONG for _, _, s in out):
        raise OverflowError("an inner product is beyond the range of a long")
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    held, n = [], 0

    def joined() -> tuple[np.ndarray, pa.Array]:
        return np.concatenate([b.column(0).to_numpy() for b in held]), pa.concat_arrays([b.column(1) for b in held])

    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            held.append(batch.slice(at, TILE))
            n += held[-1].num_rows
            if n >= TILE:
                yield joined()
                held, n = [], 0
    if n:
        yield joined()


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("topk", lambda: None)
        ids, vectors, least = sent.value
        longest, searches, wide = masses(vectors, 1)[0].max(initial=0), {}, []
        for candidates, lists in _tiles(batches):
            tile = vertical(lists, len(vectors))[: len(vectors)]  # beyond them the queries go on with zeros
            # By the inequality of Cauchy and Schwarz this bounds every sum of a part of a product, too.
            most = (longest + 1) * (masses(tile, 1)[0].max(initial=0) + 1)
            kind = next((t for t, limit in EXACT.items() if most < limit), None)
            if kind is None:
                wide += exact_wide(candidates, tile, vectors, ids, least, k)
            else:
                if kind not in searches:
                    searches[kind] = Search(ids, vectors, k, least, kind)
                searches[kind].add(candidates, tile)
        for search in searches.values():
            yield search.found()
        if wide:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*wide)], names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    # A query row with several vectors may find one candidate more than once.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answer(candidates: DataFrame, block: pa.Table, shares: list[int], k: int) -> DataFrame:
    """The best candidates of a block of queries, by way of growing shares of the rows."""
    spark, schema = candidates.sparkSession, "query_id long, vec_id long, score long"
    ids = block["id"].to_numpy()
    vectors, least = vertical(block["v"].combine_chunks()), None
    for share in shares:
        sent = spark.sparkContext.broadcast((ids, vectors, least))
        rows = candidates.where(F.pmod(F.xxhash64("id"), F.lit(share).cast("long")) == 0) if share > 1 else candidates
        best = _best(rows.mapInArrow(_search(sent, k), schema), k)
        if share > 1:
            last = best.where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row for each query of the block
            known = dict(zip(last["query_id"].to_pylist(), last["score"].to_pylist()))
            least = np.array([known.get(i, -np.inf) for i in ids.tolist()])
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_bytes: int = QUERY_BYTES, first: int = FIRST, growth: int = GROWTH, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows for which ``is_query`` holds, against all rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.where(usable(vector) & F.col(id).isNotNull())
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    size = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries"), F.max(F.when(F.col("asks"), F.size("v"))).alias("width")).first()
    if not size["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = -(-size["queries"] * size["width"] * 8 // query_bytes)
    parts = min(parts, size["queries"])
    shares = [1]
    while size["rows"] > first * shares[-1]:
        shares.append(shares[-1] * growth)
    queries = rows.where("asks").select("id", "v").distinct()
    if parts == 1:
        return _answer(rows.select("id", "v"), queries.toArrow(), shares[::-1], k)
    queries = materialise(queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts).cast("long")).cast("int")), "queries", "part")
    path = new_path(spark, "answers")
    for part in range(parts):
        block = queries.where(F.col("part") == part).select("id", "v").toArrow()
        if block.num_rows:
            _answer(rows.select("id", "v"), block, shares[::-1], k).write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {K}"""
