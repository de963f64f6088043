"""Dates, windows, joins and aggregates over events, orders and the other tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.dates import seconds_of
from quire.operators import calendar as cal
from quire.operators import ledger, relational
from quire.plans.registry import Tables, query

AS_OF = datetime.date(2001, 12, 31)
#: Ledger price of an event's value, in and out.
YEARS = (1994, 2002)


@query("""
WITH b AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum((p IS NULL OR p <> event_type)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b)
SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS total FROM i GROUP BY 1, 2""")
def event_islands(t: Tables) -> DataFrame:
    """Runs of one type of event."""
    rows = relational.islands(t.events, ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
i AS (SELECT *, sum((p IS NULL OR p <> role)::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM b)
SELECT conv_id, island::BIGINT AS island, any_value(role) AS role, min(turn) AS first_turn, max(turn) AS last_turn FROM i GROUP BY 1, 2""")
def line_dedup_islands(t: Tables) -> DataFrame:
    """Turn ranges by role."""
    rows = relational.islands(t.conversations, ["conv_id"], ["turn"], "role")
    return rows.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2)
SELECT user_id, arg_min(event_type, (-n, seen)) AS event_type, max(n) AS n FROM c GROUP BY 1""")
def mode_first_seen(t: Tables) -> DataFrame:
    """The most frequent type of each user, ties to the one seen first."""
    return relational.mode_first_seen(t.events, ["user_id"], "event_type", "event_id")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup FROM events""")
def forward_fill(t: Tables) -> DataFrame:
    """The last signup before each event."""
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return relational.forward_fill(t.events, ["user_id"], ["ts", "event_id"], signup, "signup", False).select("event_id", "user_id", "signup")


@query("""
WITH p AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts WHERE e.event_type = 'click'""")
def asof_forward_purchase(t: Tables) -> DataFrame:
    """The first purchase at or after each click."""
    marks = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    out = relational.asof_forward(t.events.where("event_type = 'click'").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", ["purchase"])
    return out.select("event_id", "user_id", "purchase")


@query("""
SELECT o_orderkey, o_custkey, o_orderdate::DATE AS start, coalesce(lead(o_orderdate::DATE) OVER w, DATE '2001-12-31') AS until,
  date_diff('day', o_orderdate::DATE, coalesce(lead(o_orderdate::DATE) OVER w, DATE '2001-12-31'))::INTEGER AS days, lead(o_orderkey) OVER w IS NULL AS ongoing
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)""")
def next_interval_chain(t: Tables) -> DataFrame:
    """From each order of a customer to the next, the last to a given day."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("start"))
    w = Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")
    follow = F.lead("start").over(w)
    rows = rows.withColumns({"until": F.coalesce(follow, F.lit(AS_OF)), "ongoing": follow.isNull()})
    return rows.withColumn("days", F.datediff("until", "start"))


_SECONDS = "(date_diff('day', DATE '1970-01-01', ts::DATE) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))"


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type, {_SECONDS} AS s FROM events),
d AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS e FROM e),
iv AS (SELECT user_id, event_type, s, e FROM d WHERE e > s),
g AS (SELECT DISTINCT user_id, s // 86400 AS day FROM e),
p AS (SELECT g.user_id, g.day, iv.event_type, iv.s, least(iv.e, (g.day + 1) * 86400) - greatest(iv.s, g.day * 86400) AS overlap FROM g JOIN iv ON g.user_id = iv.user_id AND iv.s < (g.day + 1) * 86400 AND iv.e > g.day * 86400)
SELECT g.user_id, g.day::BIGINT AS day, arg_max(p.event_type, (p.overlap, -p.s)) AS best_label, max(p.overlap)::BIGINT AS best_overlap FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.day = g.day GROUP BY 1, 2""")
def interval_overlap_argmax(t: Tables) -> DataFrame:
    """What each user's day was mostly spent after, of the intervals between events."""
    events = t.events.select("user_id", "event_id", "event_type", seconds_of(F.col("ts")).alias("s"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    intervals = events.withColumn("e", F.lead("s").over(w)).where("e > s").select("user_id", "event_type", "s", "e")
    days = events.select("user_id", F.floor(F.col("s") / 86400).alias("day")).distinct()
    days = days.withColumns({"from": F.col("day") * 86400, "to": (F.col("day") + 1) * 86400})
    out = relational.best_overlap(days, intervals, ["user_id"], ["user_id", "day"], ("from", "to"), ("s", "e"), "event_type", 86400)
    return out.select("user_id", "day", "best_label", "best_overlap")


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, {_SECONDS} AS s FROM events), u AS (SELECT user_id, s, min(event_id) AS event_id FROM e WHERE event_type = 'error' GROUP BY ALL),
b AS (SELECT e.event_id, e.s, u.s AS bs, u.event_id AS be FROM e ASOF LEFT JOIN u ON e.user_id = u.user_id AND e.s >= u.s WHERE e.event_type = 'purchase'),
a AS (SELECT e.event_id, u.s AS s2, u.event_id AS ae FROM e ASOF LEFT JOIN u ON e.user_id = u.user_id AND e.s <= u.s WHERE e.event_type = 'purchase')
SELECT b.event_id, CASE WHEN bs IS NOT NULL AND (s2 IS NULL OR s - bs <= s2 - s) THEN be ELSE ae END AS nearest_label FROM b JOIN a ON a.event_id = b.event_id""")
def nearest_error(t: Tables) -> DataFrame:
    """J12, fallback: the error nearest to each purchase, on either side."""
    events = t.events.select("event_id", "user_id", "event_type", seconds_of(F.col("ts")).alias("s"))
    errors = events.where("event_type = 'error'").groupBy("user_id", "s").agg(F.min("event_id").alias("error"))
    errors = errors.select("user_id", F.col("s").alias("from"), F.col("s").alias("to"), "error")
    return relational.nearest_label(events.where("event_type = 'purchase'"), errors, ["user_id"], "s", ("from", "to"), "error").select("event_id", "nearest_label")


@query("""
SELECT s_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_partkey BETWEEN s_suppkey * 20 AND s_suppkey * 20 + 24 GROUP BY 1""")
def page_range_resolve(t: Tables) -> DataFrame:
    """Keys resolved to the overlapping ranges that hold them."""
    ranges = t.supplier.select("s_suppkey", (F.col("s_suppkey") * 20).alias("first"), (F.col("s_suppkey") * 20 + 24).alias("last"))
    rows = relational.in_range(t.lineitem.select("l_partkey", "l_quantity"), ranges, "l_partkey", "first", "last", 32)
    return rows.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


PHASES = {"signup": "opening", "view": "course", "click": "course", "purchase": "closing"}


@query("SELECT CASE event_type WHEN 'signup' THEN 'opening' WHEN 'view' THEN 'course' WHEN 'click' THEN 'course' WHEN 'purchase' THEN 'closing' ELSE 'other' END AS phase, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def phase_counts(t: Tables) -> DataFrame:
    """Events by phase."""
    phases = t.spark.createDataFrame(list(PHASES.items()), "kind string, phase string")
    rows = t.events.join(F.broadcast(phases), F.col("event_type") == F.col("kind"), "left")
    return rows.groupBy(F.coalesce("phase", F.lit("other")).alias("phase")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def year_summary(t: Tables) -> DataFrame:
    """A5: a year in one row."""
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.countDistinct("o_custkey").alias("customers"))


_FIXED = ", ".join(f"({m}, {d}, '{n}')" for m, d, n in cal.FIXED)
_MOVING = ", ".join(f"({d}, '{n}')" for d, n in cal.MOVING)
#: The anonymous Gregorian algorithm, so that the check does not repeat what it checks.
CALENDAR_SQL = f"""
y AS (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1})) AS y),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS d FROM e4),
named AS (SELECT make_date(y, m, d) AS day, name, 0 AS rank FROM y, (VALUES {_FIXED}) f(m, d, name) UNION ALL SELECT (easter.d + n)::DATE, name, 1 FROM easter, (VALUES {_MOVING}) v(n, name)),
holiday AS (SELECT day, arg_max(name, rank) AS name FROM named GROUP BY day),
days AS (SELECT unnest(range(DATE '{YEARS[0]}-01-01', DATE '{YEARS[1]}-12-31' + 1, INTERVAL 1 DAY))::DATE AS day),
reasons AS (SELECT days.day, CASE WHEN isodow(days.day) = 6 THEN 'saturday' WHEN isodow(days.day) = 7 THEN 'sunday' WHEN name IS NOT NULL THEN 'holiday: ' || name END AS reason FROM days LEFT JOIN holiday ON holiday.day = days.day),
calendar AS (SELECT day, reason, min(CASE WHEN reason IS NULL THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_business FROM reasons)
"""


@query(f"WITH {CALENDAR_SQL} SELECT day, reason, next_business FROM calendar")
def business_calendar(t: Tables) -> DataFrame:
    """Every day, why it is no business day, and the next that is one."""
    return cal.calendar(t.spark, *YEARS)


DAYS = {"1-URGENT": 2, "2-HIGH": 5, "3-MEDIUM": 10, "4-NOT SPECIFIED": 15, "5-LOW": 0}
_DAYS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in DAYS.items())
_DEADLINE = f"""WITH {CALENDAR_SQL},
o AS (SELECT o_orderkey, o_orderdate::DATE AS notice, CASE o_orderpriority {_DAYS} END AS days FROM orders),
s AS (SELECT o.*, c.next_business AS starts FROM o LEFT JOIN calendar c ON c.day = o.notice + 1),
n AS (SELECT *, CASE WHEN days > 0 THEN starts + (days - 1) END AS nominal FROM s),
d AS (SELECT n.*, c.next_business AS due FROM n LEFT JOIN calendar c ON c.day = n.nominal)
"""


def _orders(t: Tables) -> DataFrame:
    days = F.create_map(*(x for k, v in DAYS.items() for x in (F.lit(k), F.lit(v))))
    return t.orders.select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("notice"), F.element_at(days, F.col("o_orderpriority")).alias("days"))


@query(_DEADLINE + "SELECT o_orderkey, notice, days, starts, nominal, due, due > nominal AS moved FROM d")
def deadline(t: Tables) -> DataFrame:
    """Deadlines from notices."""
    rows = cal.deadline(_orders(t), cal.calendar(t.spark, *YEARS), "notice", "days")
    return rows.select("o_orderkey", "notice", "days", "starts", "nominal", "due", "moved")


@query(_DEADLINE + """SELECT year(notice)::INTEGER AS year, count(*) AS deadlines, sum(date_diff('day', starts, nominal) + 1)::BIGINT AS counted, count(*) FILTER (due > nominal) AS moved,
  count(*) FILTER (date_diff('day', notice, starts) > 1) AS late_starts FROM d WHERE nominal IS NOT NULL GROUP BY 1""")
def deadline_trail(t: Tables) -> DataFrame:
    """Every counted day of every deadline, summed by year of notice."""
    calendar = cal.calendar(t.spark, *YEARS)
    rows = cal.deadline(_orders(t), calendar, "notice", "days").where("nominal IS NOT NULL")
    counted = cal.trail(rows, calendar, "o_orderkey").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("c"), F.max(F.contains("note", F.lit("moves"))).alias("m"))
    joined = rows.join(counted, F.col("o_orderkey") == F.col("k"))
    return joined.groupBy(F.year("notice").alias("year")).agg(F.count("*").alias("deadlines"), F.sum("c").alias("counted"), F.count_if("m").alias("moved"), F.count_if(F.datediff("starts", "notice") > 1).alias("late_starts"))


_RULES = {"1-URGENT": [("answer", 10), ("appeal", 5)], "2-HIGH": [("appeal", 5), ("writ", 0)], "3-MEDIUM": [("clarification", 2)]}
_SPECIAL = {"2-HIGH": [("oral defence", 0), ("appeal", 10)]}
_RULE_ROWS = ", ".join(f"('{k}', '{p}', {d})" for k, own in (_RULES | _SPECIAL).items() for p, d in own)


@query(f"""WITH {CALENDAR_SQL},
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) v(kind, piece, days)),
o AS (SELECT o_orderkey, piece, days, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS notice FROM orders JOIN rules ON kind = o_orderpriority),
s AS (SELECT o.*, c.next_business AS starts FROM o LEFT JOIN calendar c ON c.day = o.notice + 1),
n AS (SELECT *, CASE WHEN days > 0 THEN starts + (days - 1) END AS nominal FROM s),
d AS (SELECT n.*, c.next_business AS due FROM n LEFT JOIN calendar c ON c.day = n.nominal)
SELECT o_orderkey, piece, days, due, CASE WHEN notice IS NULL THEN 'no date' WHEN days = 0 THEN NULL WHEN due < DATE '2001-07-01' THEN 'overdue' ELSE date_diff('day', DATE '2001-07-01', due) || ' days left' END AS status FROM d""")
def deadline_radar(t: Tables) -> DataFrame:
    """Which act opens which term, special rules before the default ones, and how it stands."""
    special, default = cal.term_rules(t.spark, _SPECIAL), cal.term_rules(t.spark, _RULES)
    kinds = t.spark.createDataFrame([(k,) for k in _RULES], "kind string")
    rules = relational.override(kinds, special, default, "kind").select("kind", "piece", "days")
    acts = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("act_kind"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("notice"))
    out = cal.radar(acts, rules, cal.calendar(t.spark, *YEARS), "act_kind", "notice", datetime.date(2001, 7, 1))
    return out.select("o_orderkey", "piece", "days", "due", "status")


_MONTHS = "CASE WHEN p > 144 THEN 240 WHEN p > 96 THEN 192 WHEN p > 48 THEN 144 WHEN p > 24 THEN 96 WHEN p >= 12 THEN 48 WHEN fact < DATE '2010-05-06' THEN 24 ELSE 36 END"


@query(f"""
WITH q AS (SELECT l_orderkey, sum(l_quantity)::INTEGER AS p FROM lineitem GROUP BY 1),
f AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS fact, p FROM orders JOIN q ON l_orderkey = o_orderkey),
m AS (SELECT *, {_MONTHS} // 12 AS months, lead(fact) OVER (PARTITION BY o_custkey ORDER BY fact, o_orderkey) AS nxt FROM f)
SELECT o_orderkey, p, months::INTEGER AS months, coalesce(nxt, DATE '2001-12-31') AS until, (fact + to_months(months::INTEGER))::DATE + 7 AS barred_on, coalesce(nxt, DATE '2001-12-31') > (fact + to_months(months::INTEGER))::DATE + 7 AS barred, nxt IS NULL AS ongoing FROM m""")
def limitation_period(t: Tables) -> DataFrame:
    """Limits by penalty (a twelfth, to make them matter here), interval by interval, with a suspension of seven days."""
    penalty = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("p"))
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("fact")).join(penalty, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("months", F.floor(cal.limitation_months(F.col("p"), F.col("fact")) / 12).cast("int"))
    rows = rows.withColumn("at", F.struct("fact", "o_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("fact", "o_orderkey")
    follow = F.lead("fact").over(w)
    limit = F.date_add(F.add_months("fact", F.col("months")), 7)
    rows = rows.withColumns({"until": F.coalesce(follow, F.lit(AS_OF)), "ongoing": follow.isNull(), "barred_on": limit}).withColumn("barred", F.col("until") > F.col("barred_on"))
    return rows.select("o_orderkey", "p", "months", "until", "barred_on", "barred", "ongoing")


@query("""
WITH e AS (SELECT ts::DATE AS day, 'event' AS kind, event_id AS id, event_type AS label FROM events WHERE event_type IN ('signup', 'purchase')
UNION ALL SELECT o_orderdate::DATE, 'order', o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P')
SELECT day, kind, count(*) AS n, min(id) AS first_id, count(DISTINCT label) AS labels FROM e GROUP BY 1, 2""")
def timeline(t: Tables) -> DataFrame:
    """Milestones of two kinds on one line."""
    a = t.events.where("event_type IN ('signup', 'purchase')").select(F.col("ts").cast("date").alias("day"), F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("label"))
    b = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderdate").cast("date").alias("day"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return a.unionByName(b).groupBy("day", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.countDistinct("label").alias("labels"))


_LEDGER = "SELECT event_type, (props->>'k')::BIGINT AS k, value FROM events WHERE event_type <> 'view'"


@query(f"""
SELECT event_type, count(*) AS n, sum(k)::BIGINT AS tokens, round(sum(value), 4) AS cost, 'detail' AS level FROM ({_LEDGER}) GROUP BY 1
UNION ALL SELECT NULL, count(*), sum(k)::BIGINT, round(sum(value), 4), 'total' FROM ({_LEDGER})""")
def cost_ledger(t: Tables) -> DataFrame:
    """Sums by model with a grand total, read from semi-structured rows."""
    rows = t.events.where("event_type <> 'view'").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    out = ledger.totals(rows, ["event_type"], {"tokens": F.col("k"), "cost": F.col("value")})
    return out.select("event_type", "n", F.col("tokens").cast("long").alias("tokens"), F.round("cost", 4).alias("cost"), "level")


@query("""
SELECT p_name, count(DISTINCT p_brand) AS origins, min(p_brand) AS first_origin, max(p_brand) AS last_origin FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def name_collisions(t: Tables) -> DataFrame:
    """Names that several origins use."""
    return relational.collisions(t.part, "p_name", "p_brand")


@query("""
SELECT n.n_nationkey, r.r_name, c.customers, s.suppliers, round(c.balance, 2) AS balance FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS customers, sum(c_acctbal) AS balance FROM customer GROUP BY 1) c ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def dimension_lookup(t: Tables) -> DataFrame:
    """Counts looked up by key, kept where nothing matches."""
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    s = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("n_nationkey", "r_name", "customers", "suppliers", F.round("balance", 2).alias("balance"))


@query("""
WITH s AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, day, n, (SELECT min(b.day) FROM s b WHERE b.user_id = s.user_id AND b.day > s.day) AS until FROM s""")
def next_later_start(t: Tables) -> DataFrame:
    """Each active day up to the next later one."""
    rows = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return relational.next_start(rows, ["user_id"], "day", F.lit(None).cast("date"))


@query("""
WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r AS (SELECT DISTINCT 'c' || c_custkey AS node, 0 AS hops FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 500 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 2)
SELECT node, min(hops)::INTEGER AS hops FROM r GROUP BY 1""")
def reachable_within(t: Tables) -> DataFrame:
    """Sub-graph within two links of some nodes, each at its shortest distance."""
    own = t.customer.where("c_mktsegment = 'BUILDING'")
    edges = own.selectExpr("'c' || c_custkey AS src", "'n' || c_nationkey AS dst").unionByName(t.nation.selectExpr("'n' || n_nationkey AS src", "'r' || n_regionkey AS dst"))
    return relational.reachable(edges, own.where("c_acctbal < 500").selectExpr("'c' || c_custkey AS node"), "src", "dst", 2)


@query("""
WITH k AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 15), n AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_nationkey > 8)
SELECT coalesce(n.c_custkey, k.c_custkey) AS c_custkey, coalesce(n.c_name, k.c_name) AS c_name, coalesce(n.c_acctbal, k.c_acctbal) AS c_acctbal FROM n FULL JOIN k ON n.c_custkey = k.c_custkey""")
def upsert_rows(t: Tables) -> DataFrame:
    """Known rows replaced or extended; what the new row lacks stays."""
    from quire.sources.sinks import upsert

    base = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    new = base.where("c_nationkey > 8").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return upsert(base.where("c_nationkey < 15").drop("c_nationkey"), new, "c_custkey")


@query("""
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE ts::DATE BETWEEN DATE '2024-01-15' - 10 AND DATE '2024-01-15') WHERE n = 1
AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE ts::DATE < DATE '2024-01-15' - 10)""")
def lookback_unseen(t: Tables) -> DataFrame:
    """D16 T4, batch twin: what a window of the last days shows for the first time."""
    from quire.streaming.incremental import lookback, unseen

    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    rows = t.events.withColumns({"key": key, "day": F.col("ts").cast("date")})
    as_of = F.lit(datetime.date(2024, 1, 15))
    return unseen(lookback(rows, "day", as_of, 10), rows.where(F.col("day") < F.date_sub(as_of, 10)), "key", ["ts", "event_id"]).select("event_id", "user_id")
