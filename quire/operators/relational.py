"""Relational operators that Spark has no name for: as-of and interval joins, islands, ordered choices, differences.

All take and return DataFrames and run no action.  Every order is made total by the columns that the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(hits: DataFrame, markers: DataFrame, keys: list[str], position: str, values: list[str], max_distance: Column | int | None = None, same_position: bool = True) -> DataFrame:
    """``hits`` with the ``values`` of the last marker at or before each (``marker_position`` too), null if it is too far.

    One shuffle on ``keys``: markers and hits are sorted together, and the last marker is carried on.  Of markers at one
    position, the one with the largest values holds.
    """
    carried = F.struct(F.col(position).alias("marker_position"), *values)
    marks = markers.select(*keys, position, carried.alias("__marker"), F.lit(0 if same_position else 1).alias("__side"))
    both = hits.withColumns({"__side": F.lit(1 if same_position else 0), "__hit": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(position, "__side", "__marker").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__marker", ignorenulls=True).over(order)).where("__hit")
    if max_distance is not None:
        near = F.col(position) - F.col("__last.marker_position") <= max_distance
        out = out.withColumn("__last", F.when(near, F.col("__last")))
    return out.select(*hits.columns, *(F.col(f"__last.{v}").alias(v) for v in ["marker_position", *values]))


def asof_forward(hits: DataFrame, markers: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    """``hits`` with the ``values`` of the first marker at or after each; of markers at one position the smallest values."""
    carried = F.struct(F.col(position).alias("marker_position"), *values)
    marks = markers.select(*keys, position, carried.alias("__marker"), F.lit(1).alias("__side"))
    both = hits.withColumns({"__side": F.lit(0), "__hit": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(position, "__side", "__marker").rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumn("__next", F.first("__marker", ignorenulls=True).over(order)).where("__hit")
    return out.select(*hits.columns, *(F.col(f"__next.{v}").alias(v) for v in ["marker_position", *values]))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs whose half-open spans overlap, with ``overlap``: an equi-join on the buckets of ``width`` that both touch.

    A pair is kept in the first bucket that both touch, so no pair comes twice and none needs a later distinct.
    """
    bucket = lambda c: F.floor(c / width)
    spread = lambda df, span, name: df.withColumn(name, F.explode(F.sequence(bucket(F.col(span[0])), bucket(F.greatest(F.col(span[1]) - 1, F.col(span[0]))))))
    l = spread(left, left_span, "__lb")
    r = spread(right.withColumnsRenamed({k: f"__r_{k}" for k in keys}), right_span, "__rb")
    on = F.col("__lb") == F.col("__rb")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    start = F.greatest(left_span[0], right_span[0])
    overlap = F.least(left_span[1], right_span[1]) - start
    joined = l.join(r, on).withColumn("overlap", overlap).where((F.col("overlap") > 0) & (F.col("__lb") == bucket(start)))
    return joined.drop("__lb", "__rb", *(f"__r_{k}" for k in keys))


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], id: list[str], left_span: tuple[str, str], right_span: tuple[str, str], label: str, width: int) -> DataFrame:
    """Each left row with the label that overlaps it most; ties to the earliest right row; null if nothing overlaps."""
    pairs = interval_join(left, right, keys, left_span, right_span, width)
    best = pairs.groupBy(*id).agg(F.max_by(F.struct(F.col(label).alias("label"), "overlap"), F.struct("overlap", -F.col(right_span[0]))).alias("__best"))
    best = best.select(*(F.col(c).alias(f"__{c}") for c in id), F.col("__best.label").alias("best_label"), F.col("__best.overlap").alias("best_overlap"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in id]
    return left.join(best, on, "left").drop(*(f"__{c}" for c in id))


def nearest_label(left: DataFrame, right: DataFrame, keys: list[str], position: str, right_span: tuple[str, str], label: str) -> DataFrame:
    """Each left row with the label of the span whose end or start is nearest: an as-of join to either side."""
    ends = right.select(*keys, F.col(right_span[1]).alias(position), F.col(label).alias("__before"))
    starts = right.select(*keys, F.col(right_span[0]).alias(position), F.col(label).alias("__after"))
    out = asof_backward(left, ends, keys, position, ["__before"]).withColumnRenamed("marker_position", "__b")
    out = asof_forward(out, starts, keys, position, ["__after"]).withColumnRenamed("marker_position", "__a")
    before = F.col("__a").isNull() | (F.col(position) - F.col("__b") <= F.col("__a") - F.col(position))
    return out.withColumn("nearest_label", F.when(F.col("__b").isNotNull() & before, F.col("__before")).otherwise(F.col("__after"))).drop("__a", "__b", "__before", "__after")


def in_range(points: DataFrame, ranges: DataFrame, point: str, first: str, last: str, width: int) -> DataFrame:
    """Points with every range [first, last] that holds them, by buckets of ``width``."""
    spread = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return points.withColumn("__pb", F.floor(F.col(point) / width)).join(spread, (F.col("__pb") == F.col("__b")) & F.col(point).between(F.col(first), F.col(last))).drop("__pb", "__b")


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, include_current: bool = True) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "island") -> DataFrame:
    """Numbers (from 1) the runs of consecutive rows with one value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    starts = F.row_number().over(w).eqNullSafe(F.lit(1)) | ~before.eqNullSafe(F.col(value))
    return rows.withColumn("__starts", starts.cast("int")).withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def segments(rows: DataFrame, keys: list[str], order: list[str], boundary: Column, name: str = "segment") -> DataFrame:
    """Numbers (from 1) the runs that begin at rows where ``boundary`` holds; the first row always begins one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = (F.row_number().over(w) == 1) | F.coalesce(boundary, F.lit(False))
    return rows.withColumn("__starts", starts.cast("int")).withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def next_start(rows: DataFrame, keys: list[str], start: str, end: Column, name: str = "until") -> DataFrame:
    """Each row's end: the next strictly later start (equal starts share one end), or ``end`` for the last."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    # Only the last of the rows that share a start sees a later one; the others take it from that row.
    shared = F.max("__next").over(Window.partitionBy(*keys, start))
    rows = rows.withColumn("__next", F.when(following > F.col(start), following)).withColumn("__next", shared)
    return rows.withColumn(name, F.coalesce("__next", end)).drop("__next")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def at_most(rows: DataFrame, keys: list[str], order: list[Column | str], each: int, overall: int | None = None) -> DataFrame:
    """At most ``each`` rows a key, then ``overall`` in the order of key and rank."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= each)
    return out.orderBy(*keys, "rank").limit(overall) if overall else out


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value a key; ties to the one seen first, then to the smaller: two aggregations, no window."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "seen", value)).alias("m")).select(*keys, f"m.{value}", "m.n")


def gaps(rows: DataFrame, number: str, keys: list[str]) -> DataFrame:
    """Numbers between 1 and a key's largest that are missing."""
    top = rows.groupBy(*keys).agg(F.max(number).cast("long").alias("__top")).where("__top >= 1")
    every = top.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__top"))).alias(number))
    return every.join(rows.select(*keys, F.col(number).cast("long").alias(number)).distinct(), [*keys, number], "left_anti")


def not_known(new: DataFrame, known: DataFrame, any_of: list[str]) -> DataFrame:
    """New rows that agree with no known row in any of the columns: one equi anti-join a column, never a nested loop."""
    for c in any_of:
        new = new.join(known.where(F.col(c).isNotNull()).select(F.col(c).alias("__k")).distinct(), F.col(c) == F.col("__k"), "left_anti")
    return new


def difference(now: DataFrame, before: DataFrame, key: str, version: str) -> DataFrame:
    """key, status (new, obsolete, reused, changed) of an incremental rebuild."""
    a = now.select(F.col(key), F.col(version).alias("__now"))
    b = before.select(F.col(key).alias("__key"), F.col(version).alias("__then"))
    status = F.when(F.col("__key").isNull(), "new").when(F.col(key).isNull(), "obsolete").when(F.col("__now").eqNullSafe(F.col("__then")), "reused").otherwise("changed")
    return a.join(b, F.col(key) == F.col("__key"), "full_outer").select(F.coalesce(key, "__key").alias(key), status.alias("status"))


def merge_candidates(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Both candidate sets by key, with ``via``: one name or both joined by ``+``."""
    l = a.withColumn("__a", F.lit(names[0]))
    r = b.withColumnRenamed(key, "__key").withColumn("__b", F.lit(names[1]))
    out = l.join(r, F.col(key) == F.col("__key"), "full_outer")
    return out.withColumns({key: F.coalesce(key, "__key"), "via": F.concat_ws("+", "__a", "__b")}).drop("__key", "__a", "__b")


def override(rows: DataFrame, special: DataFrame, default: DataFrame, key: str) -> DataFrame:
    """Joins each row with the special rules of its key if there are any, else with the default ones."""
    has = special.select(F.col(key).alias("__s")).distinct()
    rules = special.unionByName(default.join(has, F.col(key) == F.col("__s"), "left_anti"))
    return rows.join(rules, key)


def longest_existing_prefix(refs: DataFrame, known: DataFrame, ref: str, path: str, separator: str = "/") -> DataFrame:
    """Each reference with the longest of its prefixes that is known; null if none is."""
    parts = F.split(ref, F.lit(separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    exploded = refs.select(F.col(ref).alias("__ref"), F.explode(prefixes).alias("__prefix")).distinct()
    found = exploded.join(known.select(F.col(path).alias("__path")).distinct(), F.col("__prefix") == F.col("__path"))
    best = found.groupBy("__ref").agg(F.max_by("__prefix", F.length("__prefix")).alias("resolved"))
    return refs.join(best, F.col(ref) == F.col("__ref"), "left").drop("__ref")


def subtree_counts(rows: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """folder, n: rows at or below each folder, by counting every ancestor of each row."""
    parts = F.split(path, F.lit(separator))
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    return rows.select(F.explode(ancestors).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def collisions(rows: DataFrame, name: str, origin: str) -> DataFrame:
    """Names that more than one origin uses."""
    distinct = rows.select(name, origin).distinct()
    return distinct.groupBy(name).agg(F.count("*").alias("origins"), F.min(origin).alias("first_origin"), F.max(origin).alias("last_origin")).where("origins > 1")


def contradictions(edges: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    """Pairs that name each other by one relation that cannot hold both ways."""
    other = edges.select(F.col(dst).alias("__s"), F.col(src).alias("__d"), F.col(kind).alias("__k"))
    same = (F.col(src) == F.col("__s")) & (F.col(dst) == F.col("__d")) & (F.col(kind) == F.col("__k"))
    return edges.join(other, same).where(F.col(src) < F.col(dst)).select(src, dst, kind).distinct()


def reachable(edges: DataFrame, start: DataFrame, src: str, dst: str, hops: int) -> DataFrame:
    """node, hops: what lies within ``hops`` edges of the start nodes, each at its shortest distance.  ``start`` has node."""
    out = start.select("node", F.lit(0).alias("hops"))
    for h in range(1, hops + 1):
        step = out.where(F.col("hops") == h - 1).join(edges, F.col("node") == F.col(src)).select(F.col(dst).alias("node"), F.lit(h).alias("hops"))
        out = out.unionByName(step).groupBy("node").agg(F.min("hops").alias("hops"))
    return out
