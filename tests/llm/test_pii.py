import collections
import hashlib
import random
import re

from quire.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        return 13 <= len(d) <= 19 and luhn % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, *m.span()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]


def test_base_spans_same_as_the_patterns():
    rng = random.Random(1)
    for size in (8, 30, 200):
        for _ in range(4000):
            text = "".join(rng.choice("aB1239 .-+@%_()é4255") for _ in range(rng.randrange(size)))
            assert pii.base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "a@b.c%x@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "+1 (918) 555-4181.", "a" * 200_000 + "@", "1" * 100_000):
        assert pii.base_spans(text) == ([] if len(text) > 1000 else brute(text))


def planted():
    rows = [(i, f"x{i} words here please write to user{i}@mail.example soon, thanks a lot") for i in range(12)]
    rows += [(100, "say please write to someone(at)mail.example soon"), (101, "so someone(at)mail.example it is"), (102, "room 12345b is near 77777 soon"), (103, None), (104, ""), (100, "plain"), (None, "write a@b.cd")]
    return rows


def test_patterns_find_what_no_base_pattern_finds(spark):
    rows = planted()
    got = pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    key = lambda i, n: (str(i), n)
    got = sorted(got, key=lambda r: key(r.doc_id, r.spans))
    rows = sorted(rows, key=lambda x: key(x[0], "email" * ("(at)" in (x[1] or "") or "@" in (x[1] or ""))))
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, text) in zip(got, rows):
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in brute(text)) for k in range(4)]
        if "(at)" in (text or ""):
            at = text.index("someone")
            assert r.spans == f"email:{at}:{at + len('someone(at)mail.example')}" and r.n_added == 1
        else:
            assert r.spans == base and r.n_added == 0


def test_documents_and_empty(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(r.text)).encode()).hexdigest() for r in df.collect()}
    assert {r.doc_id: r.base_sha256 for r in pii.op2_pii(spark, sf_dir).collect()} == want
    assert pii.digests(pii.find(df.limit(0))).count() == 0


def test_runs_with_spaces_and_patterns_of_what_was_found(spark):
    """Numbers written with spaces are found whole; what was found induces patterns that no seed shares."""
    rows = [(i, f"x{i} please call me on +1 918 555 41{i:02} today, thanks") for i in range(30)]
    new = ["0171 555 7713", "(017) 555-7714"]
    rows += [(400 + i, f"u{i} pay with card {v} please") for i, v in enumerate(["4111 1111 1111 1111", "5500 0055 5555 5559", "4012 8888 8888 1881", "6011 0009 9013 9424", "4111 1111 1111 1112"])]
    rows += [(100 + i, f"y{i} please call me on {v} today, thanks") for i, v in enumerate(new)]
    rows += [(200 + 10 * j + i, f"z{i} desk line {v} now") for i, v in enumerate([*new, "0171 555 8888"]) for j in range(3)]
    rows += [(150, "y please call me on 0171 555 8888 today"), (300, "z desk line 0171 555 9999 now"), (301, "in 2019 10 of 77777 came")]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    text = dict(rows)
    for i in (100, 101, 150, 200, 300, 404):
        (_, a, b), = (x.split(":") for x in got[i].split(","))
        want = {100: new[0], 101: new[1], 150: "0171 555 8888", 200: new[0], 300: "0171 555 9999", 404: "4111 1111 1111 1112"}[i]
        assert text[i][int(a) : int(b)] == want
    assert got[404].startswith("card:") and got[301] == ""
    for hard in ("1" * 100_000, "1 " * 50_000, "(" * 100_000, "12 34 " * 20_000 + "x"):
        assert pii.runs(hard, []) == []


def test_neighbouring_words_do_not_depend_on_a_cut():
    long = "L" * 79
    text = f"{long} {'w' * 70} 1.2.3.4 {'r' * 79}"
    at = text.index("1.2")
    assert pii.contexts(text, at, at + 7) == [f"{long.lower()} {'w' * 70} _", f"{'w' * 70} _ {'r' * 79}"]
    huge = "a " + "h" * 5000 + " 1.2.3.4"
    assert pii.contexts(huge, len(huge) - 7, len(huge)) == [f" {'h' * 80} _", f"{'h' * 80} _ "]
    assert pii.merged([(5, 9), (1, 3), (2, 4), (8, 12), (12, 13)]) == [(1, 4), (5, 12), (12, 13)]


def discovered(found, rounds=pii.ROUNDS, support=pii.SUPPORT, accept=pii.ACCEPT):
    """The method in plain Python, over mentions of all texts: value -> kind."""
    edges = collections.Counter()
    whole = collections.Counter()
    for m in found:
        for pattern in m["contexts"]:
            edges[pattern, m["kind"], m["value"]] += 1
            whole[pattern] += m["outer"] < 0
    seeds, values = collections.Counter(), collections.Counter()
    for (pattern, kind, _), n in edges.items():
        if kind:
            seeds[pattern, kind] += n
            values[pattern, kind] += 1
    open_ = {(p, v): n for (p, k, v), n in edges.items() if not k}

    def graph(values):
        return {(p, k, v): n for (p, v), n in open_.items() for k in pii.KINDS if values[p, k] >= support and re.search(pii.SHAPES[k], v)}

    def beliefs(scores):
        out = collections.defaultdict(lambda: 1.0)
        for (_, k, v), s in scores.items():
            out[v, k] *= 1 - min(s, 0.999)
        return {key: 1 - doubt for key, doubt in out.items()}

    def accepted(scores):
        out = {}
        for (v, k), b in beliefs(scores).items():
            if b >= accept - 1e-12 and (v not in out or (b, -pii.KINDS.index(k)) > (out[v][0], -pii.KINDS.index(out[v][1]))):
                out[v] = (b, k)
        return {v: k for v, (_, k) in out.items()}

    scores = {e: seeds[e[:2]] / (whole[e[0]] + pii.SMOOTH) for e in graph(values)}
    for _ in range(rounds - 1):
        more, taken = collections.Counter(values), accepted(scores)
        for p, v in open_:
            if v in taken:
                more[p, taken[v]] += 1
        edges_now, believed, gain = graph(more), beliefs(scores), collections.Counter()
        for (p, k, v), n in edges_now.items():
            gain[p, k] += n * believed.get((v, k), 0.0)
        scores = {e: (seeds[e[:2]] + gain[e[:2]]) / (whole[e[0]] + pii.SMOOTH) for e in edges_now}
    return accepted(scores)


def test_added_spans_same_as_brute_force(spark):
    rng = random.Random(8)
    before = ["write to", "mail me at", "call", "reach us on", "see the page", "item no", "desk line"]
    after = ["soon", "today", "now, please", "and so on"]
    def value(at):
        n = rng.randrange
        mail = [f"u{n(40)}@mail.example", f"u{n(6)}(at)mail.example", f"u{n(4)} [at] mail.example"]
        phone = [f"+1 918 555 4{n(100):03}", f"0171 555 {n(30):04}", f"0171-555-{n(9):04}"]
        ip = [f"10.0.{n(4)}.{n(9)}", f"fe80::{n(8)}:1", f"300.{n(3)}.1.1"]
        other = [f"{n(99999)}x", "2019 10 11", f"no{n(50)}"]
        return rng.choice({0: mail, 1: mail, 2: phone, 3: phone + mail, 4: ip, 5: other + phone[:1], 6: phone[1:]}[at])
    rows = []
    for i in range(900):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(before))
            parts.append(f"{before[at]} {value(at)} {rng.choice(after)}")
        rows.append((i, " ".join(parts)))
    found = {i: pii.mentions(t, pii.base_spans(t)) for i, t in rows}
    new = discovered([m for ms in found.values() for m in ms])
    assert len(new) > 20 and set(new.values()) >= {"email", "phone", "ip"}
    want = {}
    for i, ms in found.items():
        added = [m for m in ms if not m["kind"] and m["value"] in new]
        starts = {m["start"] for m in added if m["outer"] < 0}
        want[i] = sorted((pii.KINDS.index(new[m["value"]]), m["start"], m["end"]) for m in added if m["outer"] < 0 or m["outer"] not in starts)
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.added] for r in got} == want and sum(map(len, want.values())) > 100


def test_two_hops(spark):
    """Instances that a seed pattern finds stand in a second context too; what only that context shares is found next."""
    rows = [(i, f"s{i} please write to user{i}@mail.example at once") for i in range(20)]
    rows += [(100 + i, f"t{i} please write to name{i}(at)mail.example at once") for i in range(8)]
    rows += [(200 + i, f"the sheet names contact name{i}(at)mail.example beside others") for i in range(8)]
    rows += [(300 + i, f"the sheet names contact other{i}(at)mail.example beside others") for i in range(2)]
    got = {r.doc_id: r.added for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[300 + i]) == 1 and got[300 + i][0].place == 0 for i in range(2))
