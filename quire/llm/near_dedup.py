"""Near-duplicate documents by MinHash with tensored banding, and verification on full shingle sets.

Two collections of ``HALVES`` half-keys, each of ``ROWS`` minhashes, give ``HALVES ** 2`` table keys by pairing: documents meet
in a table if they agree on one half-key of either collection.  At a similarity s both collections agree with probability
``(1 - (1 - s ** ROWS) ** HALVES) ** 2``, all but 2e-5 at 0.75, from 56 minhashes where separate tables of as many keys
would take 784.

Steps
  1. One pass over the texts gives each document's set size, a fingerprint of its set, its half-keys and a signature.
  2. Documents with one set become one class; only its smallest id goes on.
  3. Half-keys that one class alone has are dropped, the rest are paired to table keys; tables with the same members count once.
  4. Within a table, members whose signatures agree on at least ``LEAST_AGREE`` of 56 places (a pair at 0.75 misses that with
     probability 1e-7) are joined to candidate clusters.  Each table gives a star for each cluster, never its pairs.
  5. Within a candidate cluster all pairs that may still join two components are verified on full sets.  Tables and clusters
     beyond a size are cut into tiles.  First each member meets a few pivots; members that the best pivot links are in one
     component, so pairs among them are settled.  Only the rest meets all tiles: no pair that matters is left out, and copies
     of members grow with the number of those that no pivot links, not with the square of a cluster.
  6. Components of the verified links.

Defined results
  * null text and texts without words have an empty set and are linked with nothing; fewer than five words are one shingle;
  * rows with a null ``doc_id`` are linked with nothing: component null, kept;
  * repeated rows of one ``doc_id`` are one document: each row is returned, with one component;
  * an empty table gives an empty result; further columns are ignored by :func:`assign` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hold, materialise, read, slices, small_batches, text_or_empty
from quire.llm.components import connected_components

WORDS = 5
HALVES = 14
ROWS = 2
HASHES = 2 * HALVES * ROWS
LEAST_AGREE = 24
#: A link: 100 * intersection >= 75 * union.
PERCENT = 75
#: Members of a tile of a table, and members and shingles of a tile of a candidate cluster.
TABLE_TILE, CLUSTER_TILE, SHINGLES_TILE = 2000, 1000, 2_000_000
#: Members that all others of a large table or cluster are compared with first.
PIVOTS = 4

_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)[:, None]
_MUL = (_rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1))[:, None]


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as texts ask for."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(_BASE, -1, 2**64)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sequence(text: str, words: int = WORDS, table: bytes = _LOWER) -> np.ndarray:
    """The 64-bit hash of each run of ``words`` words in order; fewer words are one run.  ``table`` says what separates words."""
    data = np.frombuffer(b" ".join(text.encode("utf-8", "surrogatepass").translate(table).split()), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(data) + 1)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    k = min(words, len(starts))
    first, last = starts[: len(starts) - k + 1], ends[k - 1 :]
    return mix((total[last] - total[first]) * down[first])


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_sequence(text, words))


def minhashes(shingles: np.ndarray, step: int = 2048) -> np.ndarray:
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), step):
        np.minimum(out, ((shingles[at : at + step] ^ _XOR) * _MUL).min(1), out=out)
    return out


def half_keys(mins: np.ndarray) -> np.ndarray:
    """``HALVES`` keys of the first collection, then as many of the second; no key value is shared between places."""
    x = mins.reshape(2 * HALVES, ROWS)
    out = np.arange(2 * HALVES, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        out = mix(out * np.uint64(_BASE) + x[:, r])
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("near_dedup", _POWERS.reset)
    for batch in slices(batches):
        n, f1, f2, keys, sigs = [], [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            f1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
            f2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(_BASE))).astype(np.int64)) if len(s) else 0)
            mins = minhashes(s)
            keys.append(half_keys(mins).astype(np.int64) if len(s) else np.zeros(0, np.int64))
            sigs.append((mins & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "keys", "sig"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), keys (half-keys), sig (a byte of each minhash)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_describe, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sig binary")


class _Union:
    def __init__(self, ids: np.ndarray) -> None:
        self.root = np.arange(len(ids))

    def join(self, i: int, others: np.ndarray) -> None:
        group = np.unique(np.append(self.root[others], self.root[i]))
        if len(group) > 1:
            self.root[np.isin(self.root, group)] = group[0]


def _stars(ids: np.ndarray, union: _Union) -> Iterator[tuple[int, int]]:
    """(smallest id, member) for each group of two and more distinct ids."""
    for r in np.unique(union.root):
        own = np.unique(ids[union.root == r])
        yield from ((int(own[0]), int(x)) for x in own[1:])


def agreeing(ids: np.ndarray, side: np.ndarray, sigs: np.ndarray, cross: bool) -> Iterator[tuple[int, int]]:
    """Stars of the members whose signatures agree well enough; ``cross``: pairs of different sides only."""
    union = _Union(ids)
    for i in range(len(ids) - 1):
        others = np.flatnonzero(union.root[i + 1 :] != union.root[i]) + i + 1
        if cross:
            others = others[side[others] != side[i]]
        if len(others):
            close = others[(sigs[others] == sigs[i]).sum(1) >= LEAST_AGREE]
            if len(close):
                union.join(i, close)
    return _stars(ids, union)


def linked(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], cross: bool) -> Iterator[tuple[int, int]]:
    """Stars of the members that verified links connect.  A pair is left out only if its two are connected already, or if
    their sizes alone rule a link out."""
    union, sizes = _Union(ids), np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[inverse] > 1  # what one member alone has adds nothing to an intersection
    owner = np.repeat(np.arange(len(sets)), sizes)[shared]
    flat = inverse[shared]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    mark = np.zeros(len(values), np.int64)
    for i in range(len(ids) - 1):
        others = np.flatnonzero(union.root[i + 1 :] != union.root[i]) + i + 1
        if cross:
            others = others[side[others] != side[i]]
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= PERCENT * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        own = flat[bounds[i] : bounds[i + 1]]
        mark[own] = 1
        if len(others) * 4 > len(ids) - i:
            sums = np.concatenate([[0], np.cumsum(mark[flat[bounds[i + 1] :]])])
            both = sums[bounds[others + 1] - bounds[i + 1]] - sums[bounds[others] - bounds[i + 1]]
        else:
            both = np.array([int(mark[flat[bounds[j] : bounds[j + 1]]].sum()) for j in others])
        mark[own] = 0
        close = others[100 * both >= PERCENT * (sizes[i] + sizes[others] - both)]
        if len(close):
            union.join(i, close)
    return _stars(ids, union)


def _by_cell(work: Callable) -> Callable:
    """Runs ``work`` on each run of rows of one cell; the rows come sorted by cell.  Columns: cell, id, side, cross, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(rows: list) -> pa.RecordBatch:
            stars = list(work(rows)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in stars], pa.int64()), pa.array([b for _, b in stars], pa.int64())], names=["a", "b"])

        hold("near_dedup", _POWERS.reset)
        cell, rows = None, []
        for batch in slices(batches):
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[0] != cell:
                    if (out := finished(rows)).num_rows:
                        yield out
                    cell, rows = row[0], []
                rows.append(row)
        if (out := finished(rows)).num_rows:
            yield out

    return run


def _table_work(rows: list) -> Iterator[tuple[int, int]]:
    ids, side = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    sigs = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), HASHES)
    return agreeing(ids, side, sigs, rows[0][3])


def _cluster_work(rows: list) -> Iterator[tuple[int, int]]:
    ids, side = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return linked(ids, side, [np.frombuffer(r[4], np.uint64) for r in rows], rows[0][3])


def _alike_signatures(pivot: bytes, others: list[bytes]) -> np.ndarray:
    sigs = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), HASHES)
    return (sigs == np.frombuffer(pivot, np.uint8)).sum(1) >= LEAST_AGREE


def _linked_sets(pivot: bytes, others: list[bytes]) -> np.ndarray:
    own = np.frombuffer(pivot, np.uint64)
    sizes = np.array([len(o) // 8 for o in others])
    hit = np.concatenate([[0], np.cumsum(np.isin(np.frombuffer(b"".join(others), np.uint64), own))])
    ends = np.cumsum(sizes)
    both = hit[ends] - hit[ends - sizes]
    return 100 * both >= PERCENT * (len(own) + sizes - both)


def _by_pivots(close: Callable) -> Callable:
    """(key, pivot, member) of the links that ``close`` finds in each run of rows of one cell.  Columns: cell, key, id, pivot, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(rows: list) -> pa.RecordBatch:
            out, members = [], [r for r in rows if not r[3]]
            for _, key, pivot, is_pivot, data in rows:
                if is_pivot and members:
                    out += [(key, pivot, members[i][2]) for i in np.flatnonzero(close(data, [m[4] for m in members])).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["key", "pivot", "member"])

        hold("near_dedup", _POWERS.reset)
        cell, rows = None, []
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != cell:
                    if (out := finished(rows)).num_rows:
                        yield out
                    cell, rows = row[0], []
                rows.append(row)
        if (out := finished(rows)).num_rows:
            yield out

    return run


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell")


def tiled_links(members: DataFrame, any_large: bool, work: Callable, close: Callable) -> DataFrame:
    """Stars (a, b) that connect the members of each key as all their links do; ``members`` has key, id, n_shingles, tiles, data.

    A key of one tile is one cell.  Of the others every member first meets the pivots of its key, tile by tile; those that
    the best pivot links need no comparison with each other.
    """
    none = F.lit(False)
    members = materialise(members, "members") if any_large else members
    single = members.where("tiles = 1").select(F.xxhash64("key").alias("cell"), "id", F.lit(0).alias("side"), none.alias("cross"), "data")
    stars = "a long, b long"
    out = _dealt(single).mapInArrow(_by_cell(work), stars)
    if not any_large:
        return out.distinct()
    large = members.where("tiles > 1")
    tile = lambda of: F.pmod(F.xxhash64("id", "n_shingles"), of).cast("int")
    pivots = large.groupBy("key").agg(F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id"))["id"] for i in range(PIVOTS)))).alias("p"))
    pivots = materialise(pivots.select(F.col("key").alias("pk"), F.explode("p").alias("pid")), "pivots")
    own = large.select(F.xxhash64("key", tile(F.col("tiles"))).alias("cell"), "key", "id", none.alias("pivot"), "data")
    copied = large.join(pivots, (F.col("key") == F.col("pk")) & (F.col("id") == F.col("pid"))).select("key", "id", "data", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    copied = copied.select(F.xxhash64("key", "t").alias("cell"), "key", "id", F.lit(True).alias("pivot"), "data")
    linked_ = materialise(_dealt(own.unionByName(copied)).mapInArrow(_by_pivots(close), "key long, pivot long, member long"), "pivot-links")
    counts = linked_.groupBy("key", "pivot").agg(F.count("*").alias("n"))
    best = counts.groupBy(F.col("key").alias("bk")).agg(F.max_by("pivot", F.struct("n", "pivot")).alias("bp"))
    settled = linked_.join(best, (F.col("key") == F.col("bk")) & (F.col("pivot") == F.col("bp"))).select(F.col("key").alias("sk"), F.col("member").alias("sid"))
    marked = large.join(settled, (F.col("key") == F.col("sk")) & (F.col("id") == F.col("sid")), "left").withColumn("rest", F.col("sid").isNull()).drop("sk", "sid")
    marked = materialise(marked, "marked")
    share = marked.groupBy(F.col("key").alias("rk")).agg((F.count_if("rest") / F.count("*")).alias("share")).where("share > 0")
    marked = marked.join(share, F.col("key") == F.col("rk")).withColumn("rests", F.ceil(F.col("share") * F.col("tiles")).cast("int"))
    to = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias("other")
    # Cells of two tiles of the rest, or of one and one of the settled; a tile's own pairs are compared in its own cell.
    rest = marked.where("rest").withColumn("side", tile(F.col("rests")))
    among = rest.select("*", to("rests")).select(F.xxhash64("key", F.lit("rest"), F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "id", "side", (F.col("side") != F.col("other")).alias("cross"), "data")
    across = rest.select("*", to("tiles")).select(F.xxhash64("key", F.lit("settled"), "side", "other").alias("cell"), "id", F.lit(0).alias("side"), F.lit(True).alias("cross"), "data")
    against = marked.where("NOT rest").withColumn("own", tile(F.col("tiles"))).select("*", to("rests")).select(F.xxhash64("key", F.lit("settled"), "other", "own").alias("cell"), "id", F.lit(1).alias("side"), F.lit(True).alias("cross"), "data")
    more = _dealt(among.unionByName(across).unionByName(against)).mapInArrow(_by_cell(work), stars)
    pivoted = linked_.where("pivot <> member").select(F.least("pivot", "member").alias("a"), F.greatest("pivot", "member").alias("b"))
    return out.unionByName(pivoted).unionByName(more).distinct()


def candidate_edges(classes: DataFrame, tile: int = TABLE_TILE) -> DataFrame:
    """Stars (a, b) of ids whose signatures agree within some table."""
    halves = classes.select("id", "n_shingles", F.posexplode("keys").alias("place", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select(F.col("half").alias("shared_half"))
    rest = halves.join(shared, F.col("half") == F.col("shared_half"))
    own = rest.groupBy("id", "n_shingles").agg(F.collect_set(F.when(F.col("place") < HALVES, F.col("half"))).alias("first"), F.collect_set(F.when(F.col("place") >= HALVES, F.col("half"))).alias("second"))
    keyed = own.select("id", F.explode("first").alias("h1"), "second").select("id", "h1", F.explode("second").alias("h2")).select("id", F.xxhash64("h1", "h2").alias("table"))
    keyed = materialise(keyed, "tables")
    tables = keyed.groupBy("table").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("members"))
    once = tables.where("lo < hi").groupBy("n", "lo", "hi", "members").agg(F.min("table").alias("table"))
    once = materialise(once.select("table", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "distinct-tables")
    members = keyed.join(once, "table").join(classes.select("id", "n_shingles", "sig"), "id")
    members = members.select(F.col("table").alias("key"), "id", "n_shingles", "tiles", F.col("sig").alias("data"))
    return tiled_links(members, not once.where("tiles > 1").isEmpty(), _table_work, _alike_signatures)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("near_dedup", _POWERS.reset)
    for batch in slices(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column(3)]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "tiles", "n_shingles", "shingles"])


def verified_edges(docs: DataFrame, classes: DataFrame, clusters: DataFrame, tile: int = CLUSTER_TILE, shingles_tile: int = SHINGLES_TILE) -> DataFrame:
    """Stars (a, b) of ids that links on full sets connect; ``clusters`` has node, root."""
    sized = clusters.join(classes.select(F.col("id").alias("node"), "n_shingles"), "node")
    sizes = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    tiles = materialise(sizes.select("root", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("s") / shingles_tile)).cast("int").alias("tiles")), "sizes")
    nodes = clusters.join(tiles, "root").select("node", F.col("root").alias("cluster"), "tiles")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    rows = texts.join(nodes, F.col("id") == F.col("node")).select("id", "cluster", "tiles", "text")
    sets = rows.mapInArrow(_sets, "id long, cluster long, tiles int, n_shingles long, shingles binary").where("n_shingles > 0")
    members = sets.select(F.col("cluster").alias("key"), "id", "n_shingles", "tiles", F.col("shingles").alias("data"))
    return tiled_links(members, not tiles.where("tiles > 1").isEmpty(), _cluster_work, _linked_sets)


def assign(docs: DataFrame, table_tile: int = TABLE_TILE, cluster_tile: int = CLUSTER_TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = materialise(describe(docs), "shingled")
    same = ["f1", "f2", "n_shingles"]
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(some.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "classes")
    clusters = connected_components(materialise(candidate_edges(classes, table_tile), "candidates"), "clusters")
    links = verified_edges(docs, classes, clusters, cluster_tile)
    # A repeated id with several texts is one document: its classes are linked through it.
    of = some.select("doc_id", *same).join(classes.select(*same, "id"), same)
    apart = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = of.join(apart, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    components = connected_components(materialise(links.unionByName(repeated), "links"), "components")
    joined = rows.join(classes.select(*same, "id"), same, "left").join(components, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns."""
    drop = assign(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))
