import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import language_id as li

SF = "/root/testdata/sf0.01"
SCHEMA = "text string, host string, declared string, language int, id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.train(docs.where("doc_id % 2 = 0"))


def test_held_out_accuracy_of_the_text_alone(docs, model):
    assert model.languages == ["de", "en", "es", "fr"]
    rows = docs.where("doc_id % 2 = 1").collect()
    right = 0
    for r in rows:
        e = model.evidence(r.text)
        right += e is not None and model.languages[e.index(max(e))] == r.lang
    assert right >= 0.97 * len(rows)


def test_fused_accuracy_and_keep(spark, docs, model):
    held = docs.where("doc_id % 2 = 1")
    rows = held.select("doc_id", "text", "lang", F.col("source").alias("host"), F.col("lang").alias("declared"))
    got = li.identify(rows, model)
    assert got.count() == held.count()
    assert got.where("language = lang AND NOT rejected").count() >= 0.99 * held.count()
    kept = li.keep(held, model)
    assert kept.columns == held.columns
    assert kept.count() >= 0.999 * held.count()


def test_priors_decide_where_texts_cannot(spark, docs, model):
    """A short text that could be anything goes where its host, or else its domain, goes."""
    french = [r.text for r in docs.where("lang = 'fr'").limit(40).collect()]
    german = [r.text for r in docs.where("lang = 'de'").limit(40).collect()]
    rows = [(t, "www.blanc.example", None, 0, i) for i, t in enumerate(french)] + [(t, "www.weiss.example", None, 0, i) for i, t in enumerate(german)]
    rows += [("en", "www.blanc.example", None, 0, 100), ("en", "www.weiss.example", None, 0, 101), ("en", "neu.weiss.example", None, 0, 102), ("en", None, "fr", 0, 103)]
    df = spark.createDataFrame(rows, "text string, host string, declared string, other int, id long")
    got = {r.id: r for r in li.identify(df, model).where("id >= 100").collect()}
    e = dict(zip(model.languages, model.evidence("en")))
    assert abs(e["fr"] - e["de"]) < 2
    assert got[100].language == "fr" and got[101].language == "de" and got[102].language == "de"


def levels(host):
    labels = host.split(".")
    n = 2 if len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in li.SECOND_LEVELS else 1
    return [".".join(labels[-n:]), ".".join(labels[-n - 1 :]), host]


def by_hand(model, rows):
    """The fusion in plain Python: (language, posterior, rejected) of rows (text, host, declared)."""
    names, n = model.languages, len(model.languages)
    read = [model.read(t) for t, _, _ in rows]
    best = [r and r[0].index(max(r[0])) for r in read]
    counts = collections.defaultdict(lambda: [0.0] * n)
    for b, (_, host, _) in zip(best, rows):
        if host is not None and b is not None:
            for level in [(), *((i, name) for i, name in enumerate(levels(host)))]:
                counts[level][b] += 1

    def prior(host):
        p = [1 / n] * n
        for level in [(), *((i, name) for i, name in enumerate(levels(host)))]:
            total = sum(counts[level])
            p = [(c + li.KAPPA * q) / (total + li.KAPPA) for c, q in zip(counts[level], p)]
        return p

    like = {d: [0.5] * n for d in [*names, None]}
    for b, (_, _, declared) in zip(best, rows):
        if declared is not None and b is not None:
            like[declared if declared in names else None][b] += 1
    of = [sum(like[d][i] for d in like) for i in range(n)]
    out = []
    seen = {host for b, (_, host, _) in zip(best, rows) if b is not None}
    for found, (_, host, declared) in zip(read, rows):
        if found is None:
            out.append((None, 0.0, True))
        elif declared is not None and declared not in names and found[1] < 0:
            out.append((declared, 1 / (1 + math.exp(found[1])), 1 / (1 + math.exp(found[1])) < li.REJECT_BELOW))
        else:
            logits = list(found[0])
            if host is not None and host in seen:
                logits = [x + math.log(p) for x, p in zip(logits, prior(host))]
            if declared is not None:
                logits = [x + math.log(c / t) for x, c, t in zip(logits, like[declared if declared in names else None], of)]
            top = max(logits)
            share = 1 / sum(math.exp(x - top) for x in logits)
            out.append((names[logits.index(top)], share, share < li.REJECT_BELOW))
    return out


def test_fusion_same_as_brute_force_and_right_despite_wrong_declarations(spark, docs, model):
    """Declarations of which a third is wrong, missing or of no class, and hosts on several levels."""
    rng = random.Random(4)
    held = [(r.text, r.lang) for r in docs.where("doc_id % 2 = 1").limit(400).collect()]
    rows, truth = [], []
    for text, lang in held:
        host = rng.choice([None, f"{rng.choice('ab')}.site-{lang}.co.uk", f"www.{lang}.example", f"{lang}", "mixed.example.com.br"])
        declared = rng.choice([lang, lang, rng.choice(model.languages), None, "xx"])
        part = text if rng.random() < 0.5 else " ".join(text.split()[: rng.randrange(1, 4)])
        rows.append((part, host, declared))
        truth.append(lang)
    rows += [("ελληνικά κείμενα που δεν μοιάζουν", None, "el"), ("123", "a.b", "en"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, host string, declared string")
    got = {r.id: (r.language, r.posterior, r.rejected) for r in li.identify(df, model).collect()}
    want = by_hand(model, rows)
    for i, (language, posterior, rejected) in enumerate(want):
        assert got[i][0] == language and abs(got[i][1] - posterior) < 1e-6 and got[i][2] == rejected, rows[i]
    whole = [i for i, lang in enumerate(truth) if rows[i][0] and len(rows[i][0]) > 200]
    assert sum(got[i][0] == truth[i] for i in whole) >= 0.97 * len(whole)
    assert sum(rows[i][2] not in (None, truth[i]) for i in whole) > 0.2 * len(whole)
    docs_of = spark.createDataFrame([(i, t, d, h) for i, (t, h, d) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in li.keep(docs_of, model).collect()} == {i for i, w in enumerate(want) if not w[2]}


def test_levels_of_hosts(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.com.br", "www.example.org", "example.org", "localhost", "", "notco.uk", "a.uk.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert [list(r) for r in df.select(*li.host_levels(F.col("host"))).collect()] == [levels(h) for h in hosts]


def test_taken_names_are_refused(spark, model):
    df = spark.createDataFrame([("the house", None, None, "x")], "text string, host string, declared string, language string")
    with pytest.raises(ValueError, match="language"):
        li.identify(df, model)


def test_edges(spark, model):
    assert model.evidence("A.") is not None  # one letter is evidence, if not much
    rows = [(None, "a", "en"), ("", None, None), ("123 !?", "a", "fr"), ("the and that of the with and this", None, "xx"), ("the and that of the with and this", "a", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, host string, declared string")
    got = {r.id: r for r in li.identify(df, model).collect()}
    assert all(got[i].rejected and got[i].language is None and got[i].posterior == 0 for i in range(3))
    assert not got[3].rejected and got[3].language == "en" == got[4].language
    assert li.identify(df.limit(0), model).count() == 0
    clash = df.select("id", "text", F.col("host").alias("source"), F.col("declared").alias("lang"), F.lit(1).alias("language"), F.lit(2).alias("evidence"))
    kept = li.keep(clash, model)
    assert kept.columns == clash.columns and sorted(r.id for r in kept.collect()) == [3, 4]


def test_pages_agree_with_their_markup(spark):
    got = li.language_id_pages(spark, SF)
    assert got.count() == 250
    assert got.where("language = declared").count() >= 240


def test_rare_and_many_languages_are_classes(spark):
    """A label of 3 rows in 12,000, and 70 labels more, each get a class; an unlike text keeps its unmodelled declaration."""
    word = lambda i, j: "".join(chr(97 + (i * 7 + j * k + k * k) % 26) for k in range(3, 9))
    rows = [(i, "the house is on the hill and the river runs by it", "en") for i in range(12_000)]
    rows += [(20_000 + i, "talo on mäellä ja joki virtaa sen ohi hiljaa yöllä", "fi") for i in range(3)]
    rows += [(30_000 + 10 * i + j, " ".join(word(i, k) for k in range(j, j + 12)), f"x{i:02}") for i in range(70) for j in range(3)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = li.train(labelled)
    assert m.languages == ["en", "fi", *(f"x{i:02}" for i in range(70))]
    asked = [(0, "joki virtaa talo on mäellä", "fi"), (1, "ελληνικά κείμενα που δεν μοιάζουν με κανένα άλλο εδώ", "el"), (2, "the house is on the hill", "el"), (3, "ελληνικά κείμενα που δεν μοιάζουν", None)]
    df = spark.createDataFrame([(i, t, None, d) for i, t, d in asked], "id long, text string, host string, declared string")
    got = {r.id: r for r in li.identify(df, m).collect()}
    assert got[0].language == "fi" and not got[0].rejected
    assert got[1].language == "el" and not got[1].rejected and got[1].posterior > 0.5
    assert got[2].language == "en" and got[3].language in m.languages


def test_sample_is_bounded_by_label(spark):
    """The lowest hashes of each label, whatever the size of the others; rows without an id do not lose their label."""
    rows = [(i, f"{'ab' if i % 10 else 'cd'} {i}", "big" if i % 10 else "small") for i in range(20_000)] + [(None, "efg efg", "none")]
    usable = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keyed = usable.select("lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    cuts = {r.l: r.cut for r in li._cuts(keyed, 100).collect()}
    hashes = {}
    for r in keyed.collect():
        hashes.setdefault(r.lang, []).append(r.h)
    assert cuts == {k: sorted(v)[:100][-1] for k, v in hashes.items()}
    assert li.train(usable, rows=100).languages == ["big", "none", "small"]
