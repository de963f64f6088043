import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from quire.llm import mixing as mx

SCHEMA = "doc_id long, text string, lang string, source string, domain int"
WEIGHTS = {"domain": {"web": 5, "books": 1, "other": 0}, "lang": {"en": 3}, "source": {"src4": 4}}


def fill(children, budget):
    """Shares of (name, offer, weight): those that cannot take a full share give all, the rest is shared out anew."""
    shares, rest, left = {}, [c for c in children if c[2] > 0], budget
    while True:
        total = sum(w for _, _, w in rest)
        full = [c for c in rest if Fraction(c[1]) <= Fraction(left * c[2], total)]
        if not full:
            return shares | {n: left * w // total for n, _, w in rest}
        for n, offer, _ in full:
            shares[n] = offer
            left -= offer
        rest = [c for c in rest if c not in full]


def brute(rows, percent, epochs):
    words = lambda t: len((t or "").split())
    number = lambda s: "".join(c for c in (s or "")[3:])
    domain = lambda s: mx.DOMAINS[int(number(s)) % 4] if number(s).isdigit() else "other"
    leaves = defaultdict(list)
    for i, t, lang, source, _ in rows:
        leaves[domain(source), lang or "", source or ""].append((i, words(t)))
    held = {k: sum(n for _, n in v) for k, v in leaves.items()}

    def shares(prefix, budget):
        level = ("domain", "lang", "source")[len(prefix)]
        names = sorted({k[len(prefix)] for k in held if k[: len(prefix)] == prefix})
        offers = [(n, epochs * sum(v for k, v in held.items() if k[: len(prefix) + 1] == (*prefix, n)), WEIGHTS[level].get(n, 1)) for n in names]
        got = fill(offers, budget)
        if level == "source":
            return {(*prefix, n): b for n, b in got.items()}
        return {k: b for n, own in got.items() for k, b in shares((*prefix, n), own).items()}

    out = []
    for leaf, budget in shares((), sum(held.values()) * percent // 100).items():
        whole, rest = divmod(budget, held[leaf]) if held[leaf] else (0, 0)
        out += [(i, e) for e in range(whole) for i, _ in leaves[leaf]]
        by = defaultdict(int)
        for i, n in leaves[leaf]:
            by[hashlib.md5(f"{mx.SEED}:{whole}:{'' if i is None else i}".encode()).hexdigest()] += n
        total = 0
        for key in sorted(by):
            total += by[key]
            if rest and total <= rest:
                out += [(i, whole) for i, _ in leaves[leaf] if hashlib.md5(f"{mx.SEED}:{whole}:{'' if i is None else i}".encode()).hexdigest() == key]
    return sorted(out, key=str)


def sample():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["en", "en", "fr", None]), rng.choice(["src0", "src0", "src0", "src1", "src4", "src5", "src7", "blog", None]), 7) for i in range(600)]
    return rows + [(3, "w w", "en", "src0", 7), (None, "w w w", "en", "src0", 7), (900, None, "de", "src2", 7)]


def test_same_as_sharing_out_by_hand(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    for percent, epochs in ((60, 4), (150, 3), (30, 1), (1000, 2)):
        described = mx._described(df)
        got = mx.chosen(described, mx.plan(described, WEIGHTS, percent, epochs)).select("__id", "__epoch").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, percent, epochs), (percent, epochs)


def test_mix_passes_columns_and_takes_shares(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    got = mx.mix(df, WEIGHTS, 50)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in brute(sample(), 50, 1)), key=str)
    assert not [r for r in rows if r.source in ("blog", None)]  # weight 0
    assert mx.mix(df.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    # src0 and src4 are of one family; src0 offers too little, so src4 takes its share, not src1 of another domain.
    rows = [(1, "w " * 10, "en", "src0", 0), *((i, "w", "en", "src4", 0) for i in range(100, 200)), *((i, "w", "en", "src1", 0) for i in range(300, 400))]
    described = mx._described(spark.createDataFrame(rows, SCHEMA))
    got = {r["__source"]: r.budget for r in mx.budgets(described, {"domain": {"web": 1, "books": 1}}, 50, 1).collect()}
    assert got == {"src0": 10, "src4": 42, "src1": 52}
    assert described.agg(F.sum("__tokens")).first()[0] == 210
