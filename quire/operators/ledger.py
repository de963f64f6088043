"""Cost ledgers, volume measures and queues of model work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

#: A text is work for the local model up to so many estimated tokens.
LOCAL_TOKENS = 8000


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of a call, by the million tokens, to four places."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 4)


def totals(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Detail a key and one row of grand totals, whose keys are null; nulls add nothing."""
    aggs = [F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(name) for name, c in sums.items())]
    detail = rows.groupBy(*keys).agg(*aggs)
    total = rows.agg(*aggs).select(*(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys), "n", *sums)
    return detail.withColumn("level", F.lit("detail")).unionByName(total.withColumn("level", F.lit("total")))


def route(text: Column, limit: int = LOCAL_TOKENS) -> Column:
    return F.when(tx.token_estimate(text) <= limit, "local").otherwise("remote")


def bands(text: Column, limits: list[int]) -> Column:
    """Which of the bands between limits a text's tokens fall in, from 0."""
    out = F.lit(0)
    for limit in limits:
        out = out + (tx.token_estimate(text) > limit).cast("int")
    return out


def tasks(acts: DataFrame, extractors: DataFrame, kind: str, text: str) -> DataFrame:
    """Acts with every extractor whose kinds hold theirs and whose pattern, if it has one, occurs in their text."""
    by_kind = extractors.select("extractor", F.explode("kinds").alias("__kind"), "pattern")
    return acts.join(by_kind, F.col(kind) == F.col("__kind")).where(F.col("pattern").isNull() | F.expr(f"{text} RLIKE pattern")).drop("__kind", "pattern")


def uncached(work: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(cache.select(*keys).distinct(), keys, "left_anti")


def grounding_tally(extracted: DataFrame, keys: list[str], quotes: str, source: str) -> DataFrame:
    """How many of the quotations in extracted records their source holds."""
    from quire.operators.validate import grounded

    rows = extracted.select(*keys, F.explode(quotes).alias("__q"), source)
    return rows.groupBy(*keys).agg(F.count("*").alias("quotes"), F.count_if(F.coalesce(grounded(F.col("__q"), F.col(source)), F.lit(False))).alias("located"))


def measure_volumes(volumes: DataFrame, id: str, text: str, pages: Column, header: str, clean: str, dirty: str) -> DataFrame:
    """Per volume: distinct (class, number) of its headers, clean and corrupt ordinals and whether corruption is tolerable
    (yes, no, or no ordinals at all), characters a page and whether that is thin."""
    heads = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(header), F.lit(0)), lambda h: F.upper(tx.squeeze(h))))
    good, bad = F.regexp_count(text, F.lit(clean)), F.regexp_count(text, F.lit(dirty))
    ok = F.when(good + bad == 0, "none").when(bad * 5 > good + bad, "no").otherwise("yes")
    chars = F.try_divide(F.length(text), pages)
    return volumes.select(id, F.size(heads).alias("headers"), good.alias("clean"), bad.alias("dirty"), ok.alias("ordinals_ok"), chars.alias("chars_per_page"), (chars < 800).alias("thin"))
