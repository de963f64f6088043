"""Look-ups and filters with optional parameters: by key if the query looks like one, else by text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.search import fold


def where_given(rows: DataFrame, **conditions) -> DataFrame:
    """Equality filters; a condition of None is none, a pair is a range, a list names alternatives."""
    for column, wanted in conditions.items():
        if isinstance(wanted, tuple):
            low, high = wanted
            rows = rows.where(F.col(column) >= low) if low is not None else rows
            rows = rows.where(F.col(column) <= high) if high is not None else rows
        elif isinstance(wanted, list):
            rows = rows.where(F.col(column).isin(wanted))
        elif wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return rows


def holds(rows: DataFrame, first: str, last: str, number: int) -> DataFrame:
    """Rows whose range holds a number, such as the file that an edition is in."""
    return rows.where(F.lit(number).between(F.col(first), F.col(last)))


def contains_folded(text: Column, query: str) -> Column:
    """Case and marks ignored."""
    return F.contains(tx.fold_same_length(text), F.lit(fold(query)))


def contains_lower(text: Column, query: str) -> Column:
    """Case ignored, marks not."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def in_force(status: Column) -> Column:
    """in force, cancelled or pending, from a status in words or a flag in words; unknown is null, not in force."""
    s = tx.squash(status)
    return F.when(s.rlike("cancelad|revogad|superad|^true$|^1$"), "cancelled").when(s.rlike("penden|suspens"), "pending").when(s.rlike("vigente|valida|ativa|em vigor|^false$|^0$"), "in force")


def family(name: Column, groups: dict[str, list[str]]) -> Column:
    """The first group one of whose words a name holds."""
    out = F.lit(None).cast("string")
    for group, words in reversed(list(groups.items())):
        out = F.when(name.rlike("(?i)" + "|".join(map(re.escape, words))), F.lit(group)).otherwise(out)
    return out


def looks_like_key(query: str) -> bool:
    return bool(re.fullmatch(r"(?i)(?:art\.?\s*)?\d[\d.]*\s*[º°]?(?:-?[a-z])?", query.strip()))


def look_up(rows: DataFrame, key: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """Rows with the key, if the query looks like one, else rows whose text holds it, in the order of article numbers."""
    if looks_like_key(query):
        wanted = re.sub(r"[º°.\s]", "", re.sub(r"(?i)^art\.?\s*", "", query.strip())).upper()
        found = rows.where(tx.article_key(F.col(key)) == wanted)
    else:
        found = rows.where(contains_folded(F.col(text), query))
    found = found.orderBy(*tx.article_sort(tx.article_key(F.col(key))), key, text)
    return found.limit(limit) if limit else found


def look_up_block(rows: DataFrame, block: str, key: str, wanted_block: str, wanted_key: str) -> DataFrame:
    """The row of a key in one block of a law, and in ``hint`` the other block that has the key if this one has not."""
    same = rows.where(tx.article_key(F.col(key)) == wanted_key.upper())
    return same.groupBy(F.lit(wanted_key).alias("wanted")).agg(
        F.max(F.when(F.col(block) == wanted_block, F.struct(*[c for c in rows.columns]))).alias("found"),
        F.min(F.when(F.col(block) != wanted_block, F.col(block))).alias("__other"),
    ).select("wanted", "found", F.when(F.col("found").isNull(), F.col("__other")).alias("hint"))


def exact_else_partial(rows: DataFrame, name: str, query: str) -> DataFrame:
    """Rows of exactly that name if there are any, else those that hold it."""
    named = tx.fold_same_length(F.col(name))
    q = fold(query)
    any_exact = rows.agg(F.coalesce(F.max(named == q), F.lit(False)).alias("__any"))
    return rows.join(F.broadcast(any_exact)).where((F.col("__any") & (named == q)) | (~F.col("__any") & F.contains(named, F.lit(q)))).drop("__any")


#: Pages of a work that is bound in volumes of equal size.
PER_VOLUME = 250


def volume_of(page: Column, size: int = PER_VOLUME) -> Column:
    return (F.floor((page - 1) / size) + 1).cast("int")


def page_slice(pages: DataFrame, page: str, volume: str, first: int, count: int, size: int = PER_VOLUME) -> DataFrame:
    """Consecutive pages of a work across its volumes; the volumes are named, so that only their partitions are read."""
    volumes = list(range((first - 1) // size + 1, (first + count - 2) // size + 2))
    return pages.where(F.col(volume).isin(volumes) & F.col(page).between(first, first + count - 1))


def with_overrides(profile: dict, **overrides) -> dict:
    """A profile with some values replaced; None replaces nothing, unknown names are errors."""
    unknown = set(overrides) - set(profile)
    if unknown:
        raise KeyError(f"no such settings: {sorted(unknown)}")
    return profile | {k: v for k, v in overrides.items() if v is not None}


def edited_since(stamped: Column, modified: Column, seconds: int = 120) -> Column:
    """Whether a file was changed after it was written, and so is not to be overwritten; null stamp: it is not ours."""
    return F.when(stamped.isNull(), F.lit(True)).otherwise(modified > stamped + F.make_dt_interval(secs=F.lit(seconds)))


def status_order(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """The exit status of a batch: errors before pending before ok."""
    from quire.operators.validate import worst

    return rows.groupBy(*keys).agg(F.count("*").alias("n"), worst(F.col(status), ["error", "loss", "pending", "ok"]).alias("status"))


def safe_path(path: Column) -> Column:
    """Whether a path stays below the folder it is taken from: relative, without a drive, and no step up in it."""
    steps = F.split(F.translate(path, "\\", "/"), "/", -1)
    return ~(F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("\\")) | F.startswith(path, F.lit("~")) | path.rlike("^[A-Za-z]:") | F.array_contains(steps, ".."))
