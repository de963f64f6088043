"""Grounding of quotations and citations, quality lint, loss rulers and gates.  Outcomes have three values: what is not
found is not thereby absent, and what cannot be measured is never called intact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.similarity import longest_block_share, similarity

#: Characters between a citation and a quotation that belongs to it, on either side, and the length of such a quotation.
AFTER, BEFORE, QUOTED = 160, 60, (25, 600)


def adjacent_quote(text: Column, start: Column, end: Column, after: int = AFTER, before: int = BEFORE) -> Column:
    """A quotation of 25 to 600 characters that begins soon after a citation or ends just before it.

    The text beside a citation is cut at quotation marks, straight ones and curly ones alike: what follows is silence and then
    what is quoted, and what precedes ends with what is quoted and then silence.
    """
    least, most = QUOTED
    cut = lambda t: F.split(F.translate(t, "“”", '""'), '"', -1)
    following = cut(F.substring(text, end, F.lit(after + most + 2)))
    room = F.least(start - 1, F.lit(before + most + 2))
    preceding = F.reverse(cut(F.substring(text, start - room, room)))
    fits = lambda parts, silence: F.when((F.size(parts) >= 3) & (F.length(F.get(parts, 0)) <= silence) & F.length(F.get(parts, 1)).between(least, most), F.get(parts, 1))
    return F.coalesce(fits(following, after), fits(preceding, before))


#: A quotation agrees with its source if their longest common block is at least this share of it.
LEAST_SHARE = 0.5


def verify(cited: DataFrame, sources: DataFrame, quote: str | None = None) -> DataFrame:
    """``cited`` (kind, number, scope) with status and body.  ``sources`` has kind, key, scope (court or law), body, cancelled.

    NO_SOURCE: nothing of the kind and scope is known at all; NOT_FOUND: the key is not among what is known; AMBIGUOUS: no
    scope was cited and several hold the key; CANCELLED; DIVERGES: the quotation is not the source's; else OK.
    """
    key, scope = tx.article_key(F.regexp_replace("number", r"\.", "")), F.lower("scope")
    cited = cited.withColumns({"__row": F.monotonically_increasing_id(), "__key": key, "__scope": scope})
    known = sources.select("kind", "scope").distinct().groupBy("kind").agg(F.collect_set("scope").alias("__scopes"))  # courts and laws: a short list
    cited = cited.join(known.withColumnRenamed("kind", "__k"), F.col("kind") == F.col("__k"), "left").drop("__k")
    s = sources.select(F.col("kind").alias("__k"), F.col("key").alias("__skey"), F.col("scope").alias("__sscope"), F.col("body").alias("__body"), F.coalesce("cancelled", F.lit(False)).alias("__cancelled"))
    hit = cited.join(s, (F.col("kind") == F.col("__k")) & (F.col("__key") == F.col("__skey")) & (F.col("__scope").isNull() | (F.col("__scope") == F.col("__sscope"))), "left")
    rows = hit.groupBy("__row").agg(F.count("__k").alias("__hits"), F.max("__cancelled").alias("__cancelled"), F.min("__body").alias("body"))
    out = cited.join(rows, "__row")
    covered = F.col("__scopes").isNotNull() & (F.col("__scope").isNull() | F.array_contains("__scopes", F.col("__scope")))
    status = F.when(~covered, "NO_SOURCE").when(F.col("__hits") == 0, "NOT_FOUND").when(F.col("__hits") > 1, "AMBIGUOUS").when(F.col("__cancelled"), "CANCELLED")
    if quote is not None:
        share = longest_block_share(tx.squash(F.col(quote)), tx.squash(F.col("body")))
        status = status.when(F.col(quote).isNotNull() & (share < LEAST_SHARE), "DIVERGES")
    return out.withColumn("status", status.otherwise("OK")).drop("__row", "__key", "__scope", "__scopes", "__hits", "__cancelled")


def resolve_id(cited: DataFrame, acts: DataFrame, id: str, page: str, least: float = 0.9) -> DataFrame:
    """``cited`` (with __cite as its key) and act: of the acts that carry the id, also as a variant, the one that holds the
    page, else the one whose own id it is, else the first; ids that none carries are matched to alike ones of one length."""
    own = acts.select("act", "id", "pag_ini", "pag_fim", F.explode(F.array_distinct(F.concat(F.array("id"), "variants"))).alias("__id")).where("__id IS NOT NULL")
    exact = cited.join(own, F.col(id) == F.col("__id"))
    rest = cited.join(exact.select(F.col("__cite").alias("__c")).distinct(), F.col("__cite") == F.col("__c"), "left_anti")
    alike = rest.join(own, F.length(id) == F.length("__id")).where(similarity(F.col(id), F.col("__id")) >= least)
    every = exact.unionByName(alike)
    rank = F.struct(~F.coalesce(F.col(page).between(F.col("pag_ini"), F.col("pag_fim")), F.lit(False)), ~F.coalesce(F.col("id") == F.col("__id"), F.lit(False)), F.col("act"))
    best = every.groupBy(F.col("__cite").alias("__c")).agg(F.min_by("act", rank).alias("act"))
    return cited.join(best, F.col("__cite") == F.col("__c"), "left").drop("__c")


def grounded(quote: Column, source: Column) -> Column:
    """Whether a source holds a quotation: whole, or two of its thirds; null for quotations under 8 characters."""
    q, s = tx.squash(quote), tx.squash(source)
    third = F.floor(F.length(q) / 3).cast("int")
    part = lambda i: F.contains(s, F.substring(q, third * i + 1, third)).cast("int")
    return F.when(F.length(q) >= 8, F.contains(s, q) | ((third >= 4) & (part(0) + part(1) + part(2) >= 2)))


def keywords(text: Column, stop: list[str], least: int = 4) -> Column:
    """Distinct folded words of ``least`` letters and more that are no stop words."""
    return F.array_except(F.array_distinct(F.filter(tx.tokens(text), lambda t: F.length(t) >= least)), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))


def coverage(wanted: Column, given: Column) -> Column:
    """Share of the wanted keywords that are given; null if none is wanted."""
    return F.try_divide(F.size(F.array_intersect(wanted, given)), F.size(wanted))


def loss(source: Column, out: Column, least: float = 0.98, most_missing: int = 200) -> Column:
    """intact, loss or unmeasured: letters and digits of the result against those of the source."""
    a, b = tx.alnum_count(source), tx.alnum_count(out)
    return F.when(a.isNull() | b.isNull() | (a == 0), "unmeasured").when((b < least * a) | (a - b > most_missing), "loss").otherwise("intact")


def regression(old: Column, new: Column) -> dict[str, Column]:
    """How a new conversion compares with an old one: letters with marks, and signs of damage."""
    accents, damage = r"[À-ÖØ-öø-ÿ]", r"\uFFFD|Ã[\u0080-\u00BF]|\?{3,}"
    return {"accents_old": F.regexp_count(old, F.lit(accents)), "accents_new": F.regexp_count(new, F.lit(accents)), "damage_old": F.regexp_count(old, F.lit(damage)), "damage_new": F.regexp_count(new, F.lit(damage))}


MOJIBAKE = r"Ã[\x80-\xBF]|Â[\xA0-\xBF]|\uFFFD"
ENTITY = r"&(?:[a-z]+|#\d+);"


def lint(rows: DataFrame, dataset: str, number: str, text: str, short: int = 15) -> DataFrame:
    """One row a dataset: counts of rows, repeated numbers, gaps up to the largest, short, damaged and undecoded texts, and
    of texts that open like another one."""
    head = F.left(tx.squash(F.col(text)), F.lit(40))
    flags = rows.groupBy(dataset).agg(
        F.count("*").alias("n_rows"), F.count(number).alias("__numbered"), F.max(number).cast("long").alias("largest"),
        F.count_if(F.length(F.trim(text)) < short).alias("short"), F.count_if(F.col(text).rlike(MOJIBAKE)).alias("mojibake"),
        F.count_if(F.col(text).rlike(ENTITY)).alias("entities"), F.count_if(F.col(text).isNull()).alias("missing_text"),
    )
    distinct = rows.where(F.col(number).isNotNull()).groupBy(dataset, number).agg(F.count("*").alias("c")).groupBy(dataset).agg(F.count("*").alias("__distinct"), F.count_if((F.col(number) >= 1)).alias("__positive"))
    heads = rows.select(dataset, head.alias("h")).where("h <> ''").groupBy(dataset, "h").agg(F.count("*").alias("c")).where("c > 1").groupBy(dataset).agg(F.sum("c").cast("long").alias("same_head"))
    out = flags.join(distinct, dataset, "left").join(heads, dataset, "left")
    gaps = F.greatest(F.coalesce("largest", F.lit(0)) - F.coalesce("__positive", F.lit(0)), F.lit(0))
    return out.select(dataset, "n_rows", (F.col("__numbered") - F.coalesce("__distinct", F.lit(0))).alias("repeated"), gaps.alias("gaps"), "short", "mojibake", "entities", "missing_text", F.coalesce("same_head", F.lit(0)).alias("same_head"))


def gate(rows: DataFrame, keys: list[str], severity: str) -> DataFrame:
    """n, alerts, high and status a key: APPROVED without alerts, REJECTED with a high one, else ALERT."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(severity).isNotNull()).alias("alerts"), F.count_if(F.coalesce(F.col(severity) == "high", F.lit(False))).alias("high"))
    return out.withColumn("status", F.when(F.col("high") > 0, "REJECTED").when(F.col("alerts") > 0, "ALERT").otherwise("APPROVED"))


def worst(status: Column, order: list[str]) -> Column:
    """The aggregate that keeps the worst of several outcomes, worst first."""
    place = F.array_position(F.array(*map(F.lit, order)), status)
    return F.element_at(F.array(*map(F.lit, order)), F.min(F.when(place > 0, place)).cast("int"))


def annotate(texts: DataFrame, marks: DataFrame, id: str, text: str) -> DataFrame:
    """``texts`` with a mark inserted after each span.  ``marks`` has id, end (exclusive, from 1) and mark; of marks at one
    place all are kept, in order.  Inserting from the back leaves earlier positions valid."""
    own = marks.groupBy(F.col(id).alias("__id")).agg(F.sort_array(F.collect_list(F.struct("end", "mark")), asc=False).alias("__m"))
    put = F.aggregate("__m", F.col(text), lambda acc, m: F.concat(F.substring(acc, F.lit(1), m["end"] - 1), F.lit(" "), m["mark"], F.substring(acc, m["end"], F.length(acc))))
    return texts.join(own, F.col(id) == F.col("__id"), "left").withColumn(text, F.coalesce(put, F.col(text))).drop("__id", "__m")


def draft_alerts(sections: DataFrame, id: str) -> DataFrame:
    """id, rule, severity, detail: structure of a draft whose sections have title and body."""
    from quire.operators.segment import requests

    folded = tx.squash(F.col("title"))
    kinds = sections.withColumns({"__asks": F.coalesce(folded.rlike("pedido|requer"), F.lit(False)), "__facts": F.coalesce(folded.rlike("fato|sintese|relato"), F.lit(False))})
    per = kinds.groupBy(id).agg(F.max("__asks").alias("asks"), F.max("__facts").alias("facts"), F.array_join(F.collect_list(F.when(~F.col("__asks"), F.col("body"))), " ").alias("__rest"), F.flatten(F.collect_list(F.when(F.col("__asks"), requests(F.col("body"))))).alias("__items"))
    rows = per.select(id, "asks", "facts", "__rest", F.explode_outer("__items").alias("item"))
    stop = ["para", "pela", "pelo", "seja", "requer", "pedido"]
    share = coverage(keywords(F.col("item"), stop), keywords(F.col("__rest"), stop))
    alert = lambda when, rule, severity, detail: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail")))
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(alert(~F.col("asks"), "no requests", "high", none), alert(~F.col("facts"), "no facts", "medium", none), alert(F.col("item").isNotNull() & (share < 0.3), "request without ground", "medium", F.left("item", F.lit(80)))))
    return rows.select(id, F.explode(found).alias("a")).select(id, "a.*").distinct()


def suspicious(value: Column) -> Column:
    """Values that stand for none and should be filled in."""
    return value.isNull() | F.trim(F.lower(value)).isin("", "-", "null", "none", "n/a", "0000-00-00") | value.rlike(r"(?i)\[VERIFICAR|redação|da redação")


def cleaned(value: Column) -> Column:
    return F.when(~suspicious(value), F.trim(value))
