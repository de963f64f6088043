"""Mixing sources to target weights by hierarchical budgeting.

Leaves of the tree are (domain, language, source).  A leaf offers its tokens times ``max_epochs``; an inner node offers what
its leaves do.  From the root down, a node's budget is divided among its children by weight; a child that offers less than
its share gives what it has, and the shortage is divided among its siblings by weight again.  A node's budget never exceeds
its offer, so a shortage leaves a family only when all of it is used up: siblings come before ancestors.

A leaf's budget is spent on whole epochs and on a prefix of one more, whose order is seeded anew.  The prefix is found in two
steps, so that no task ever holds a leaf: tokens are summed by leaf and by the first characters of the order key, and only
the one range of keys in which the budget ends is read row by row.  What is broadcast or joined is a row for each leaf.

Everything is built from DataFrame functions, in whole numbers.

Defined results
  * a token is a word, a run of characters other than ASCII white space; null text has none;
  * null language or source form leaves of their own; weights that are not given are 1, a weight of 0 takes nothing;
  * shares are rounded down, and a prefix holds the documents that fit whole, so a leaf may fall short by a document;
  * documents without tokens come with every whole epoch of their leaf;
  * rows of one ``doc_id`` have one place in the order and are taken together; of equal keys the order is one;
  * an empty table gives an empty result; :func:`mix` passes all columns through, helper columns begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, materialise, read, text_or_empty

WORD = SPACE.replace("[", "[^") + "+"

#: The production mixture: sources are dealt to domains by their number; a source without one is of domain "other".
DOMAINS = ("web", "books", "code", "news")
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "news": 1}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 1}, "source": {}}
SEED = "mix-1"
#: The budget as a share of all tokens, in percent, and how often a leaf may be repeated.
PERCENT, MAX_EPOCHS = 60, 4
#: Characters of the key that a range is named by: 16 ** 3 ranges for each leaf.
RANGE = 3
LEAF = ["__domain", "__lang", "__source"]


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("bigint")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS) + 1).cast("int")), F.lit("other"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def key_of(seed: str, epoch: Column, id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))))


def leaf_columns(domain: Column, lang: str = "lang", source: str = "source") -> dict[str, Column]:
    return {"__domain": domain, "__lang": F.coalesce(F.col(lang), F.lit("")), "__source": F.coalesce(F.col(source), F.lit(""))}


def _weight(level: str, column: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def divide(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (offer, weight, budget of the parent) and ``share``: what each gets of its parent's budget."""
    order = Window.partitionBy(*parent).orderBy(F.col("offer") / F.col("weight"), name)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    before = F.coalesce(F.sum("offer").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = children.where("weight > 0").withColumns({"before": before, "heavier": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    here = here.withColumn("full", big("offer") * big("heavier") <= (big("budget") - big("before")) * big("weight"))
    family = Window.partitionBy(*parent)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("offer"))).over(family), F.lit(0))
    weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    here = here.withColumns({"rest": rest.cast("long"), "others": weight})
    share = F.when(F.col("full"), F.col("offer")).otherwise(F.floor(big("rest") * big("weight") / big("others")).cast("long"))
    return here.withColumn("share", share).drop("before", "heavier", "full", "rest", "others")


def budgets(rows: DataFrame, weights: dict = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each leaf: its columns, held (its tokens), budget.  ``rows`` has the leaf columns and __tokens."""
    held = materialise(rows.groupBy(*LEAF).agg(F.sum("__tokens").alias("held")), "leaves").withColumn("offer", F.col("held") * max_epochs)
    d, l, s = LEAF
    root = held.agg(F.expr(f"coalesce(sum(held) * {percent} div 100, 0)").alias("budget"))
    domains = held.groupBy(d).agg(F.sum("offer").alias("offer")).withColumn("weight", _weight("domain", d, weights)).join(F.broadcast(root))
    domains = divide(domains, [], d).select(d, F.col("share").alias("budget"))
    langs = held.groupBy(d, l).agg(F.sum("offer").alias("offer")).withColumn("weight", _weight("lang", l, weights)).join(domains, d)
    langs = divide(langs, [d], l).select(d, l, F.col("share").alias("budget"))
    leaves = held.withColumn("weight", _weight("source", s, weights)).join(langs, [d, l])
    return divide(leaves, [d, l], s).select(*LEAF, "held", F.col("share").alias("budget"))


def plan(rows: DataFrame, weights: dict = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """A row for each leaf: its columns, __epochs (whole ones), __cut (keys up to it are taken in the next one).

    ``rows`` has the leaf columns, __id and __tokens.
    """
    spent = F.expr("CASE WHEN held > 0 THEN budget div held ELSE 0 END")
    leaves = budgets(rows, weights, percent, max_epochs).withColumn("__epochs", spent).withColumn("rest", F.col("budget") - F.col("__epochs") * F.col("held"))
    leaves = materialise(leaves.select(*LEAF, "__epochs", "rest"), "budgets")
    open_ = leaves.where("rest > 0")
    keyed = rows.join(open_, LEAF).withColumn("key", key_of(seed, F.col("__epochs"), F.col("__id")))
    keyed = keyed.select(*LEAF, "rest", "key", F.left("key", F.lit(RANGE)).alias("range"), "__tokens")
    ranges = keyed.groupBy(*LEAF, "range").agg(F.sum("__tokens").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("range"))
    last = ranges.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
    last = materialise(last.select(*LEAF, "range", (F.col("rest") - F.col("upto") + F.col("t")).alias("left_over")), "ranges")
    inside = keyed.drop("rest").join(last, [*LEAF, "range"])
    fits = F.sum("__tokens").over(Window.partitionBy(*LEAF).orderBy("key")) <= F.col("left_over")
    cut = inside.withColumn("fits", fits).groupBy(*LEAF).agg(F.max(F.when(F.col("fits"), F.col("key")).otherwise(F.col("range"))).alias("__cut"))
    return materialise(leaves.join(cut, LEAF, "left").select(*LEAF, "__epochs", F.coalesce("__cut", F.lit("")).alias("__cut")), "plan")


def chosen(rows: DataFrame, leaf_plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` (with the leaf columns and __id) once for each epoch that takes them, and __epoch."""
    joined = rows.join(leaf_plan, LEAF)
    more = key_of(seed, F.col("__epochs"), F.col("__id")) <= F.col("__cut")
    epochs = F.col("__epochs").cast("int") + F.when(more, 1).otherwise(0)
    joined = joined.withColumn("__n", epochs).where("__n > 0")
    return joined.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n", "__epochs", "__cut")


def _described(docs: DataFrame) -> DataFrame:
    leaf = leaf_columns(domain_of(F.col("source")))
    return docs.select(F.col("doc_id").cast("long").alias("__id"), *(c.alias(k) for k, c in leaf.items()), tokens_of(text_or_empty()).alias("__tokens"), "lang", "source")


def mix(docs: DataFrame, weights: dict = WEIGHTS, percent: int = PERCENT, max_epochs: int = 1, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with all their columns, once for each epoch."""
    rows = materialise(_described(docs).drop("lang", "source"), "described")
    leaf_plan = plan(rows, weights, percent, max_epochs, seed)
    leaf = leaf_columns(domain_of(F.col("source")))
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").cast("long").alias("__id"), *(c.alias(k) for k, c in leaf.items()))
    return chosen(packed, leaf_plan, seed).select("__row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    rows = materialise(_described(read(spark, sf_dir, "documents")), "described")
    out = chosen(rows, plan(rows))
    return out.select(F.col("__id").alias("doc_id"), F.col("__domain").alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), F.col("__tokens").alias("tokens"))


def _oracle() -> str:
    cases = lambda level, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"

    def divided(name: str, parent: str, key: str, source: str) -> str:
        part = f"PARTITION BY {parent} " if parent else ""
        return f"""{name}_1 AS (
  SELECT *, coalesce(sum(offer) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavier
  FROM ({source}) WINDOW w AS ({part}ORDER BY offer / weight, {key})
), {name}_2 AS (SELECT *, offer::HUGEINT * heavier <= (budget - before)::HUGEINT * weight AS filled FROM {name}_1
), {name} AS (
  SELECT *, CASE WHEN filled THEN offer ELSE ((budget - coalesce(sum(offer) FILTER (filled) OVER ({part}), 0))::HUGEINT * weight
    // sum(weight) FILTER (NOT filled) OVER ({part})) END AS share FROM {name}_2
)"""

    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    return f"""
WITH r AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    coalesce([{domains}][try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % {len(DOMAINS)} + 1], 'other') AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents
), leaf AS (SELECT d, l, s, sum(tokens)::BIGINT AS held, sum(tokens)::BIGINT * {MAX_EPOCHS} AS offer FROM r GROUP BY d, l, s
), root AS (SELECT (sum(held) * {PERCENT} // 100)::BIGINT AS budget FROM leaf
), {divided("dom", "", "d", f"SELECT d, sum(offer)::BIGINT AS offer, {cases('domain', 'd')} AS weight, any_value(root.budget) AS budget FROM leaf, root GROUP BY d")}
, {divided("lan", "d", "l", f"SELECT leaf.d, l, sum(leaf.offer)::BIGINT AS offer, {cases('lang', 'l')} AS weight, any_value(dom.share) AS budget FROM leaf JOIN dom ON leaf.d = dom.d GROUP BY leaf.d, l")}
, {divided("lea", "d, l", "s", f"SELECT leaf.d, leaf.l, s, held, leaf.offer, {cases('source', 's')} AS weight, lan.share AS budget FROM leaf JOIN lan ON leaf.d = lan.d AND leaf.l = lan.l")}
, p AS (SELECT d, l, s, CASE WHEN held > 0 THEN share // held ELSE 0 END AS epochs, CASE WHEN held > 0 THEN share % held ELSE 0 END AS rest FROM lea
), k AS (SELECT r.*, epochs, rest, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM r JOIN p ON r.d = p.d AND r.l = p.l AND r.s = p.s
), c AS (SELECT *, epochs + (rest > 0 AND sum(tokens) OVER (PARTITION BY d, l, s ORDER BY key) <= rest)::INTEGER AS n FROM k
)
SELECT doc_id, d AS domain, lang, source, unnest(range(n::BIGINT))::INTEGER AS epoch, tokens FROM c"""


ORACLE = _oracle()
