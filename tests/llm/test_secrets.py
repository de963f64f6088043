import base64
import collections
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from quire.llm import secrets as sx

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def joined(spans):
    return ",".join(f"{sx.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(got, rows):
    key = lambda i, s: (str(i), s)
    want = sorted((key(i, hashlib.sha256(joined(brute(t)).encode()).hexdigest()), tuple(sum(s[1] == k for s in brute(t)) for k in range(3))) for i, t in rows)
    assert sorted((key(r.doc_id, r.base_sha256), (r.n_assign, r.n_access, r.n_hex)) for r in got) == want


def test_base_spans_same_as_the_patterns(spark):
    rng = random.Random(3)
    pieces = ["token", "secret", "PASSWORD", "api_key", "apikey", "passwd", "=", ":", " ", "'", '"', "AKIA", "ABCDEF012345", "abcdef0123456789", "x", "é", ".", "\n", "🙂", "AKIAB", "0a"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(1500)]
    rows += [(1, None), (1, ""), (None, "token = abcdefghijklmnop"), (2, "token=password: abcdefghijklmnop"), (3, "ab12" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(sx.digests(sx.find(df)).collect(), rows)
    assert sx.digests(sx.find(df.limit(0))).count() == 0


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(sx.op4_secrets(spark, sf_dir).collect(), rows)


def test_battery_tells_random_from_written(spark):
    rng = random.Random(5)
    syllables = ["tion", "ing", "ver", "ment", "al", "re", "con", "der", "ly", "pro", "est", "ca"]
    written = ["".join(rng.choice(syllables) for _ in range(8)) for _ in range(300)]
    written += ["-".join(rng.choice(syllables).capitalize() for _ in range(7)) for _ in range(150)] + ["=" * 40, "a" * 50, "0" * 30, "1234567890" * 3]
    drawn = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(40)] + ["".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(40)) for _ in range(20)]
    rows = [(i, f"see {t} there") for i, t in enumerate(written + drawn)]
    got = {r.doc_id: r for r in sx.digests(sx.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    false = sum(got[i].n_random for i in range(len(written)))
    true = sum(got[i].n_random for i in range(len(written), len(rows)))
    assert false == 0
    assert true >= 0.8 * len(drawn)
    hit = next(got[i] for i in range(len(written), len(rows)) if got[i].n_random)
    assert re.fullmatch(r"random:4:\d+", hit.spans)


def test_tokens_glued_to_a_name(spark):
    """A random value is found as well behind ``NAME=`` as alone."""
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(200)]
    rows = [(i, f"see {t} there") for i, t in enumerate(drawn)] + [(1000 + i, f"export SERVICE_ACCOUNT_LONG_NAME={t}; done") for i, t in enumerate(drawn)]
    got = {r.doc_id: r.spans for r in sx.digests(sx.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    alone = sum(got[i] == "random:4:44" for i in range(200))
    glued = sum(got[1000 + i] == "random:33:73" for i in range(200))
    assert alone >= 190 and glued >= 190
    padded = spark.createDataFrame([(1, "x " + "Zm9vYmFyQmF6MTIzNDU2Nzg5MA== y"), (2, "A" * 20 + "=" + "b" * 20), (3, "c" * 20 + "===")], "doc_id long, text string")
    texts = {r.row: r.text for r in padded.select(F.monotonically_increasing_id().alias("row"), "text").collect()}
    found = collections.defaultdict(list)
    for r in sx.spans(sx.scan(padded)).where("kind = 3").orderBy("start").collect():
        found[texts[r.row]].append(texts[r.row][r.start : r.end])
    assert sorted(found.values()) == sorted([["Zm9vYmFyQmF6MTIzNDU2Nzg5MA=="], ["A" * 20, "b" * 20], ["c" * 20]])


def tail(z):
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def by_hand(token):
    """The battery in plain Python: alphabet, number of characters, the three p-values of randomness and that of writing."""
    name, _, letters, kappa, alike = next(a for a in sx.ALPHABETS if re.search(a[1] or "", token))
    body = token.rstrip("=")
    n, k = len(body), len(letters)
    if n < sx.LEAST_TOKEN - 4:
        return name, n, None
    x = [letters.find(c) for c in body]
    squares = sum(v * v for v in collections.Counter(x).values())
    chi, df, middle = k / n * squares - n, k - 1, (k - 1) / 2
    z_chi = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    above = sum(v > middle for v in x)
    crossings = sum((a > middle) != (b > middle) for a, b in zip(x, x[1:]))
    usual = 2 * above * (n - above) / n
    p_runs = 2 * tail(abs((crossings - usual) / math.sqrt(usual * (usual - 1) / (n - 1)))) if usual > 1 else 0.0
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / ((n - 1) * (k * k - 1) / 12)
    index = (squares - n) / (n * (n - 1))
    z1 = (kappa - index) / math.sqrt(2 * kappa * (1 - kappa) / (n * (n - 1)) + 2.4 * kappa * kappa / n)
    kind = ["u" if c in sx.UPPER else "l" if c in sx.LOWER else "d" if c in sx.DIGITS else c for c in body]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    z2 = (changes - (n - 1) * sx.NATURAL_CHANGES) / math.sqrt((n - 1) * sx.NATURAL_CHANGES * (1 - sx.NATURAL_CHANGES))
    z3 = (alike - serial) * math.sqrt((n - 1) / (1 - alike * alike)) if alike else 0.0
    return name, n, (tail(z_chi), p_runs, 2 * tail(abs(serial) * math.sqrt(n - 1)), tail((z1 + z2 + z3) / math.sqrt(3 if alike else 2)))


def test_p_values_and_step_up_same_as_brute_force(spark):
    rng = random.Random(12)
    pools = [sx.DIGITS, sx.DIGITS + "abcdef", sx.LOWER, sx.UPPER + "234567", sx.LOWER + sx.DIGITS, sx.UPPER + sx.LOWER + sx.DIGITS, sx.UPPER + sx.LOWER + sx.DIGITS + "+/", sx.UPPER + sx.LOWER + "_-"]
    words = ["get", "User", "Name", "from", "the", "Table", "order", "2019", "item", "Count", "total"]
    tokens = []
    for _ in range(500):
        size = rng.randrange(20, 110)
        drawn = "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.02 else rng.choice(pools[size % 8]) for _ in range(size))
        tokens += [drawn + "=" * rng.choice([0, 0, 1, 2]), "".join(rng.choice(words) for _ in range(size // 4 + 4)), "".join(rng.choice(words + [drawn[:4]]) for _ in range(size // 4 + 4))]
    df = spark.createDataFrame(list(enumerate(tokens)), "i long, token string")
    battery = sx.battery(df)
    p = {r.i: r for r in battery.collect()}
    close = lambda a, b: math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-12)
    strata = collections.defaultdict(list)
    for i, t in enumerate(tokens):
        name, n, ps = by_hand(t)
        assert (p[i].alphabet, p[i].n) == (name, n)
        assert all(map(close, (p[i].p_chi, p[i].p_runs, p[i].p_serial, p[i].p_natural), ps)), (t, ps, p[i])
        whole = ps[3] if 3 * min(ps[:3]) >= sx.ALPHA else 1.0
        strata[name, sum(n >= at for at in sx.BANDS)].append((whole, i))
    want = set()
    for rows in strata.values():
        binned = sorted((10 ** (-min(math.floor(-10 * math.log10(x)), sx.BINS) / 10), i) for x, i in rows)
        limit = max((x for place, (x, _) in enumerate(binned, 1) if x * len(binned) <= sx.Q * place * (1 + 1e-12)), default=-1)
        want |= {i for x, i in binned if x <= limit}
    assert {r.i for r in sx.discoveries(battery).collect()} == want and 200 < len(want) < 600
