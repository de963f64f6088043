"""Secrets: base patterns, and a battery of randomness tests with length-aware control of false discoveries.

Everything is built from DataFrame functions.  Base patterns find assigned, access-key and hexadecimal secrets.  Other long
tokens are tested.  The alphabet is inferred from the characters, and three statistics are taken: chi-squared of uniformity,
runs, and serial correlation of neighbours.  Each is asked twice.  Under the hypothesis that a token is drawn from its
alphabet at random, the three give p-values of randomness.  Under the opposite hypothesis, natural writing, letters
coincide more often, runs of one character class are long and neighbours are alike; the three z-values together give the
token's p-value as a discovery.  The battery is one p-value: that of natural writing, or 1 if a test rejects randomness
(Bonferroni over the three at ``ALPHA``).  Within each stratum of alphabet and length the step-up rule takes discoveries by
this p-value so that at most ``Q`` of them are expected to be false; longer tokens, whose tests are sharper, never pay for
short ones.

Defined results
  * null and empty texts have no spans; texts are read whole; positions count code points, ends are exclusive;
  * base spans are leftmost and do not overlap within a kind; a match that fails its test is dropped without a retry;
  * added spans never overlap a base span and never change the base counts; a token ends at an inner ``=``, so a name and the
    value that it is given are two; one or two ``=`` at the end are padding and belong to it;
  * rows are told apart by position in the table, so null and repeated ``doc_id`` are returned row by row; ties do not arise;
  * an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, read, text_or_empty

KINDS = ("assign", "access", "hex", "random")
ASSIGN = """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
TOKEN_CHARS = "A-Za-z0-9+/_-"
LEAST_TOKEN = 20
TOKEN = f"(?<![{TOKEN_CHARS}])[{TOKEN_CHARS}]{{{LEAST_TOKEN},}}+(?:={{1,2}}(?![={TOKEN_CHARS}]))?"

#: Expected share of false ones among the discoveries of a stratum, and the level at which randomness is rejected.
Q, ALPHA = 0.01, 0.01
#: p-values are counted in tenths of a power of ten.
BINS = 200
#: Lengths at which a new stratum begins.
BANDS = (24, 32, 48, 96)

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, what a token must match to have it, its characters in order, and the coincidence of letters and the correlation of
#: neighbours in natural writing with it (0: no different from chance).
ALPHABETS = (
    ("decimal", "^[0-9]+$", DIGITS, 0.16, 0.0),
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6], 0.12, 0.0),
    ("HEX", "^[0-9A-F]+$", DIGITS + UPPER[:6], 0.12, 0.0),
    ("base32", "^[A-Z2-7]+=*$", UPPER + DIGITS[2:8], 0.065, 0.0),
    ("lower", "^[a-z]+$", LOWER, 0.065, 0.0),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER, 0.06, 0.2),
    ("alnum", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.06, 0.25),
    ("base64", "^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/", 0.06, 0.25),
    ("base64url", "^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_", 0.06, 0.25),
    ("mixed", "", UPPER + LOWER + DIGITS + "+/-_", 0.06, 0.25),
)
#: Natural writing changes the class of character (upper, lower, digit, other) with this probability from one to the next.
NATURAL_CHANGES = 0.12


def _hits(text: Column, kind: int, pattern: str, may: Column, ok: Column) -> Column:
    """Each match of the pattern with the gap before it; ``ok`` is read from fields m (match) and g (its last group)."""
    group = 2 if kind == 0 else 0
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    token = (lambda h: h["m"]) if kind == 3 else (lambda h: F.lit(None).cast("string"))

    def hit(h: Column) -> Column:
        return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("gap"), h["gap"], F.lit("len"), F.length(h["m"]), F.lit("ok"), ok(h), F.lit("token"), token(h))

    found = F.transform(F.filter(zipped, lambda h: h["m"].isNotNull()), hit)
    return F.when(may & F.rlike(text, F.lit(pattern)), found)


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id and hits (null if none) of every text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    text = F.col("text")
    hits = [
        _hits(text, 0, ASSIGN, F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), lambda h: F.length(h["g"]) >= 12),
        _hits(text, 1, ACCESS, F.contains(text, F.lit("AKIA")), lambda h: F.length(h["m"]) >= 18),
        # Runs that are too short are left out by the pattern: a run is maximal, so this loses no other match.
        _hits(text, 2, HEX.replace("+", "{16,}"), F.lit(True), lambda h: F.lit(True)),
        _hits(text, 3, TOKEN, F.lit(True), lambda h: F.lit(True)),
    ]
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean,token:string>>")
    return rows.select("row", "doc_id", F.concat(*(F.coalesce(h, none) for h in hits)).alias("hits"))


def spans(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end, ok, token for every hit: positions are running sums of gaps and lengths."""
    rows = scanned.where(F.size("hits") > 0).select("row", F.posexplode("hits").alias("pos", "h")).select("row", "pos", "h.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("pos")).cast("int")
    return rows.withColumn("end", end).select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "ok", "token")


# The coefficients of the Chebyshev fit of the complementary error function in Numerical Recipes, section 6.2;
# its fractional error is below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: Column) -> Column:
    """P(Z >= z) to seven places of its own size, kept above zero."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    exponent = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        exponent = c + t * exponent
    upper = 0.5 * t * F.exp(-x * x + exponent)
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-300))


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` with alphabet, p_chi, p_runs, p_serial (under randomness) and p_natural (under natural writing).

    The tests see a token without its padding; each p-value is null for tokens too short to be tested.
    """
    body = F.regexp_replace("token", "=+$", "")
    pick = lambda value: F.coalesce(*(F.when(F.lit(True) if not rx else F.col("token").rlike(rx), value(a)) for a in ALPHABETS for rx in [a[1]]))
    t = tokens.withColumns({"body": body, "alphabet": pick(lambda a: F.lit(a[0]))})
    t = t.withColumns({"letters": pick(lambda a: F.lit(a[2])), "coincidence": pick(lambda a: F.lit(a[3])), "alike": pick(lambda a: F.lit(a[4]))})
    t = t.withColumns({"n": F.length("body").cast("double"), "k": F.length("letters").cast("double")})
    places = F.transform(F.split("body", ""), lambda c: F.position(c, F.col("letters")).cast("double") - 1)
    classes = F.split(F.translate("body", UPPER + LOWER + DIGITS, "u" * 26 + "l" * 26 + "d" * 10), "")
    t = t.withColumns({"x": places, "c": classes}).withColumns({"y": F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), "e": F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))})
    middle, spread = (F.col("k") - 1) / 2, (F.col("k") * F.col("k") - 1) / 12
    zero = F.lit(0.0)
    squares = F.aggregate(F.array_distinct("x"), zero, lambda acc, v: acc + F.pow(F.size(F.filter("x", lambda w: w == v)).cast("double"), F.lit(2.0)))
    above = F.size(F.filter("x", lambda v: v > middle)).cast("double")
    ones = lambda pairs: F.aggregate(pairs, zero, lambda acc, v: acc + v)
    t = t.withColumns({
        "squares": squares,
        "above": above,
        "runs": 1 + ones(F.zip_with(F.slice("x", 1, F.size("y")), "y", lambda a, b: F.when((a > middle) != (b > middle), 1.0).otherwise(0.0))),
        "products": ones(F.zip_with(F.slice("x", 1, F.size("y")), "y", lambda a, b: (a - middle) * (b - middle))),
        "changes": ones(F.zip_with(F.slice("c", 1, F.size("e")), "e", lambda a, b: F.when(a != b, 1.0).otherwise(0.0))),
    })
    n, k = F.col("n"), F.col("k")
    chi, df = k / n * F.col("squares") - n, k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    below = n - F.col("above")
    crossing = 2 * F.col("above") * below / n
    z_runs = F.abs(F.try_divide(F.col("runs") - 1 - crossing, F.sqrt(F.try_divide(crossing * (crossing - 1), n - 1))))
    serial = F.col("products") / ((n - 1) * spread)
    z_serial = F.abs(serial) * F.sqrt(n - 1)
    kappa, index = F.col("coincidence"), (F.col("squares") - n) / (n * (n - 1))
    # Variance of the coincidence index of n natural letters; the third moment of their shares is taken as 1.6 squares.
    z_letters = (kappa - index) / F.sqrt(2 * kappa * (1 - kappa) / (n * (n - 1)) + 4 * 0.6 * kappa * kappa / n)
    z_classes = (F.col("changes") - (n - 1) * NATURAL_CHANGES) / F.sqrt((n - 1) * NATURAL_CHANGES * (1 - NATURAL_CHANGES))
    # Neighbours say nothing where natural ones are no more alike than others.
    z_alike = F.when(F.col("alike") > 0, (F.col("alike") - serial) * F.sqrt((n - 1) / (1 - F.col("alike") * F.col("alike")))).otherwise(0.0)
    z_natural = (z_letters + z_classes + z_alike) / F.sqrt(2 + F.when(F.col("alike") > 0, 1.0).otherwise(0.0))
    tested = lambda p: F.when(n >= LEAST_TOKEN - 4, p)
    return t.select(
        *tokens.columns, "alphabet", F.col("n").cast("int").alias("n"), tested(normal_tail(z_chi)).alias("p_chi"), tested(F.coalesce(2 * normal_tail(z_runs), F.lit(0.0))).alias("p_runs"),
        tested(2 * normal_tail(z_serial)).alias("p_serial"), tested(normal_tail(z_natural)).alias("p_natural"),
    )


def combined(alpha: float = ALPHA) -> Column:
    """The battery's p-value: of natural writing, but 1 for tokens that some test calls less than random."""
    return F.when(3 * F.least("p_chi", "p_runs", "p_serial") >= alpha, F.col("p_natural")).otherwise(F.when(F.col("p_natural").isNotNull(), 1.0))


def discoveries(tested: DataFrame, q: float = Q, alpha: float = ALPHA) -> DataFrame:
    """The tokens that the step-up rule takes within their stratum, by the battery's p-value.

    The rule needs only counts of p-values: at most ``BINS`` rows for each of a few dozen strata, whatever the input.  A
    p-value counts as the upper end of its bin, so binning never takes more tokens than the rule itself.
    """
    band = F.lit(0)
    for at in BANDS:
        band = band + (F.col("n") >= at).cast("int")
    rows = tested.withColumn("__p", combined(alpha)).where("__p IS NOT NULL")
    rows = rows.withColumns({"band": band, "bin": F.least(F.floor(-10 * F.log10("__p")), F.lit(BINS)).cast("int")})
    counts = rows.groupBy("alphabet", "band", "bin").agg(F.count("*").alias("found"))
    stratum = Window.partitionBy("alphabet", "band")
    upto = F.sum("found").over(stratum.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    least = counts.withColumns({"upto": upto, "all": F.sum("found").over(stratum)}).where(F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= q * F.col("upto"))
    least = least.groupBy("alphabet", "band").agg(F.min("bin").alias("least"))
    return rows.join(materialise(least, "strata"), ["alphabet", "band"]).where(F.col("bin") >= F.col("least")).select(*tested.columns)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: arrays of (start, kind, end) in this order; a row for each row of ``docs``."""
    rows = materialise(scan(docs), "scanned")
    every = spans(rows)
    base = every.where("kind < 3 AND ok").select("row", "kind", "start", "end")
    held = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    free = every.where("kind = 3").join(held, (F.col("row") == F.col("r")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_anti")
    tested = materialise(battery(free.select("row", "kind", "start", "end", "token")), "tested")
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    per_row = lambda df, name: df.groupBy(F.col("row").alias(f"{name}_row")).agg(listed.alias(name))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = rows.select("row", "doc_id")
    for name, df in (("base", base), ("added", discoveries(tested))):
        out = out.join(per_row(df, name), F.col("row") == F.col(f"{name}_row"), "left")
    return out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _joined(spans_: Column) -> Column:
    name = lambda kind: F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: int) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)


def digests(found: DataFrame) -> DataFrame:
    counts = [F.size(_of_kind(i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return digests(find(read(spark, sf_dir, "documents")))
