"""Business calendars, deadlines, radar of deadlines, and limitation periods: relational date logic, with ``as_of`` given."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.dates import age_at, easter, in_recess

# National holidays (month, day, name) and those counted from Easter (days, name).
FIXED = [(1, 1, "new year"), (4, 21, "tiradentes"), (5, 1, "labour"), (9, 7, "independence"), (10, 12, "aparecida"), (11, 2, "all souls"), (11, 15, "republic"), (11, 20, "black awareness"), (12, 25, "christmas")]
MOVING = [(-48, "carnival monday"), (-47, "carnival tuesday"), (-46, "ash wednesday"), (-2, "good friday"), (60, "corpus christi")]


def holidays(spark: SparkSession, first_year: int, last_year: int, local: DataFrame | None = None, district: str | None = None, general: tuple[str, ...] = ()) -> DataFrame:
    """day, name.  ``local`` (day, scope, name): general scopes always count, others if they are the district; they overlay."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    fixed = F.array(*(F.struct(F.make_date("y", F.lit(m), F.lit(d)).alias("day"), F.lit(n).alias("name")) for m, d, n in FIXED))
    moving = F.array(*(F.struct(F.date_add(easter(F.col("y")), days).alias("day"), F.lit(n).alias("name")) for days, n in MOVING))
    # Of two names of one day the later listed one holds, and a local one above both.
    out = years.select(F.posexplode(F.concat(fixed, moving)).alias("rank", "h")).select("h.day", "h.name", "rank")
    if local is not None:
        from quire.operators.search import fold

        own = F.lit(False) if district is None else F.lower(F.trim("scope")) == fold(district).strip()
        out = out.unionByName(local.where(F.col("scope").isin(list(general)) | own).select("day", "name", F.lit(1000).alias("rank")))
    return out.groupBy("day").agg(F.max_by("name", F.struct("rank", "name")).alias("name"))


def calendar(spark: SparkSession, first_year: int, last_year: int, named: DataFrame | None = None, recess: bool = False) -> DataFrame:
    """day, reason (null on business days), next_business (the first business day at or after it).

    A few hundred rows a year: the window over all of it runs once, whatever the size of what is joined with it.
    """
    named = holidays(spark, first_year, last_year) if named is None else named
    start, end = datetime.date(first_year, 1, 1), datetime.date(last_year, 12, 31)
    days = spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    week = F.dayofweek("day")
    reason = F.when(week == 7, "saturday").when(week == 1, "sunday").when(F.col("name").isNotNull(), F.concat(F.lit("holiday: "), F.col("name")))
    if recess:
        reason = reason.when(in_recess(F.col("day")), "recess")
    rows = days.join(F.broadcast(named.select(F.col("day").alias("__h"), "name")), F.col("day") == F.col("__h"), "left").withColumn("reason", reason)
    following = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    return rows.select("day", "reason", F.min(F.when(F.col("reason").isNull(), F.col("day"))).over(following).alias("next_business"))


def deadline(rows: DataFrame, cal: DataFrame, notice: str, days: str) -> DataFrame:
    """``rows`` and starts, nominal, due, moved: counting begins the day after notice, or the next business day; days run on
    the calendar; an end on no business day moves forward.  No days: no end.  Two joins with the calendar."""
    at = lambda name: F.broadcast(cal.select(F.col("day").alias(f"__{name}_day"), F.col("next_business").alias(name)))
    rows = rows.withColumn("__after", F.date_add(F.col(notice), 1)).join(at("starts"), F.col("__after") == F.col("__starts_day"), "left")
    rows = rows.withColumn("nominal", F.when(F.col(days) > 0, F.date_add("starts", (F.col(days) - 1).cast("int"))))
    rows = rows.join(at("due"), F.col("nominal") == F.col("__due_day"), "left")
    return rows.withColumn("moved", F.col("due") > F.col("nominal")).drop("__after", "__starts_day", "__due_day")


def trail(rows: DataFrame, cal: DataFrame, id: str) -> DataFrame:
    """id, day, note for each day that a deadline counts, and where its end moves."""
    days = rows.where("nominal IS NOT NULL").select(id, "nominal", "due", F.explode(F.sequence("starts", "nominal")).alias("day"))
    noted = days.join(F.broadcast(cal.select(F.col("day").alias("__d"), "reason")), F.col("day") == F.col("__d"), "left")
    moves = F.when((F.col("day") == F.col("nominal")) & (F.col("due") > F.col("nominal")), F.concat(F.lit("; moves to "), F.col("due").cast("string"))).otherwise("")
    return noted.select(id, "day", F.concat(F.coalesce(F.concat(F.lit("counts all the same ("), F.col("reason"), F.lit(")")), F.lit("counts")), moves).alias("note"))


# What the defence may file after each kind of act, and in how many days (0: no term).
TERMS = {
    "DENUNCIA": [("resposta à acusação", 10), ("defesa prévia", 10)],
    "RECEBIMENTO DENUNCIA": [("resposta à acusação", 10)],
    "DECISAO": [("recurso em sentido estrito", 5), ("embargos de declaração", 2), ("habeas corpus", 0)],
    "PRONUNCIA": [("recurso em sentido estrito", 5)],
    "SENTENCA": [("apelação", 5), ("embargos de declaração", 2)],
    "ACORDAO": [("embargos de declaração", 2), ("embargos infringentes e de nulidade", 10), ("recurso especial / extraordinário", 15), ("recurso ordinário em HC", 5)],
    "INTIMACAO": [("manifestação", 5)],
    "TERMO DE AUDIENCIA": [("memoriais", 5)],
    "ALEGACOES FINAIS": [("memoriais da defesa", 5)],
    "CERTIDAO DE PUBLICACAO": [("prazo do ato publicado", 0)],
}
SUMMARY_TERMS = {
    "SENTENCA": [("apelação", 10), ("embargos de declaração", 5)],
    "ACORDAO": [("embargos de declaração", 5), ("recurso extraordinário", 15)],
    "DENUNCIA": [("defesa oral", 0)],
}


def term_rules(spark: SparkSession, terms: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    rows = [(kind, piece, days) for kind, own in (TERMS if terms is None else terms).items() for piece, days in own]
    return spark.createDataFrame(rows, "kind string, piece string, days int")


def procedure_of(cover: Column) -> Column:
    """jecrim, sumario or ordinario, from the head of a cover."""
    head = F.upper(F.left(cover, F.lit(4000)))
    very = head.rlike("SUMAR") & head.rlike("[IÍ]SSIMO") | head.rlike("JUIZADO ESPECIAL")
    return F.when(very, "jecrim").when(head.rlike(r"PROCEDIMENTO\s+SUM[ÁA]RIO\b"), "sumario").otherwise("ordinario")


def radar(acts: DataFrame, rules: DataFrame, cal: DataFrame, kind: str, date: str, as_of: datetime.date) -> DataFrame:
    """A row for each act and rule (kind, piece, days), with its due date and status."""
    rows = deadline(acts.join(rules, acts[kind] == rules["kind"]).drop(rules["kind"]), cal, date, "days")
    left = F.datediff("due", F.lit(as_of))
    status = F.when(F.col(date).isNull(), "no date").when(F.col("days") == 0, None).when(left < 0, "overdue").otherwise(F.format_string("%d days left", left))
    return rows.withColumn("status", status)


#: Facts before this day take two years where later ones take three.
SHORT_TERM_CHANGE = datetime.date(2010, 5, 6)


def limitation_months(penalty: Column, fact: Column) -> Column:
    """Months after which a penalty of so many months at most is barred."""
    short = F.when(fact < F.lit(SHORT_TERM_CHANGE), 24).otherwise(36)
    return F.when(penalty > 144, 240).when(penalty > 96, 192).when(penalty > 48, 144).when(penalty > 24, 96).when(penalty >= 12, 48).otherwise(short)


def halved(months: Column, birth: Column, fact: Column, sentence: Column) -> Column:
    """Half of it for those under 21 at the fact or over 70 at the sentence."""
    young = F.coalesce(age_at(birth, fact) < 21, F.lit(False))
    old = F.coalesce(age_at(birth, sentence) > 70, F.lit(False))
    return F.when(young | old, F.floor(months / 2)).otherwise(months).cast("int")


def limitation_intervals(milestones: DataFrame, keys: list[str], date: str, months: str, as_of: datetime.date, suspended: Column | int = 0) -> DataFrame:
    """Each milestone's interval to the next one, or to ``as_of``: until, days, barred_on, barred, ongoing.

    Days of suspension lengthen every interval, as the rules that this follows have it; ``barred`` only strictly after the limit.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    rows = milestones.withColumn("__next", F.lead(date).over(w))
    rows = rows.withColumns({"until": F.coalesce("__next", F.lit(as_of)), "ongoing": F.col("__next").isNull()})
    limit = F.date_add(F.add_months(date, F.col(months)), suspended if not isinstance(suspended, int) else F.lit(suspended))
    return rows.withColumns({"days": F.datediff("until", date), "barred_on": limit}).withColumn("barred", F.col("until") > F.col("barred_on")).drop("__next")


# Kinds of act that interrupt, and the phase that a kind belongs to.
INTERRUPTS = ["RECEBIMENTO DENUNCIA", "PRONUNCIA", "SENTENCA", "ACORDAO"]


def milestones_of(acts: DataFrame, kind: str, date: str) -> DataFrame:
    """Acts that interrupt and have a date."""
    return acts.where(F.col(kind).isin(INTERRUPTS) & F.col(date).isNotNull())
