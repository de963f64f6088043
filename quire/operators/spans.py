"""Positions of pattern matches as rows, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stands for a match between gaps; in a text it counts as a blank.
MARK = "\x01"


def spans(docs: DataFrame, id: str, text: Column, patterns: dict[str, str], groups: int = 0) -> DataFrame:
    """id, kind, n, start, end, match and g1..: leftmost matches of each pattern; start from 1, end exclusive, in code points.

    The gaps between matches and the matches themselves alternate, so positions are running sums of their lengths.  Only
    rows with a match are exploded; the window orders one document's matches of one kind.
    """
    hits = []
    for kind, pattern in patterns.items():
        # A split by the pattern itself would have it compiled anew for every row; a replacement keeps it.
        gaps = F.split(F.regexp_replace("__t", F.lit(pattern), F.lit(MARK)), MARK, -1)
        parts = [F.transform(gaps, lambda p: F.length(p)).alias("gap"), F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)).alias("match")]
        parts += [F.regexp_extract_all("__t", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)]
        found = F.filter(F.arrays_zip(*parts), lambda h: h["match"].isNotNull())
        hits.append(F.when(F.rlike("__t", F.lit(pattern)), F.transform(found, _named(kind, groups))))
    empty = F.array().cast(f"array<struct<kind:string,gap:int,match:string{''.join(f',g{g}:string' for g in range(1, groups + 1))}>>")
    rows = docs.select(F.col(id), F.translate(text, MARK, " ").alias("__t"))
    # Outer, as the planner would have every pattern looked for once more to find that there is something to explode.
    rows = rows.select(id, F.posexplode_outer(F.concat(*(F.coalesce(h, empty) for h in hits))).alias("__pos", "__x")).where("__x IS NOT NULL").select(id, "__pos", "__x.*")
    w = Window.partitionBy(id, "kind").orderBy("__pos")
    end = F.sum(F.col("gap") + F.length("match")).over(w) + 1
    rows = rows.withColumns({"n": F.row_number().over(w), "end": end.cast("int")}).withColumn("start", F.col("end") - F.length("match"))
    return rows.select(id, "kind", "n", "start", "end", "match", *(f"g{g}" for g in range(1, groups + 1)))


def _named(kind: str, groups: int):
    fields = lambda h: [x for g in range(1, groups + 1) for x in (F.lit(f"g{g}"), h[f"g{g}"])]
    return lambda h: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("gap"), h["gap"], F.lit("match"), h["match"], *fields(h))


def outside(inner: DataFrame, outer: DataFrame, id: str) -> DataFrame:
    """Spans that do not begin within one of the outer spans of their document."""
    o = outer.select(F.col(id).alias("__id"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    return inner.join(o, (F.col(id) == F.col("__id")) & (F.col("start") >= F.col("__s")) & (F.col("start") < F.col("__e")), "left_anti")
