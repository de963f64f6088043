"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from byte trigrams.  It is combined with the language that the row declares
(a markup attribute or a column) and with the prior of its host.  Priors are smoothed down a hierarchy: all rows, the
suffix of the address, its registered domain, the host; each level is a grouped count of what the texts alone say, and
shrinks to the level above by ``KAPPA`` rows.  How far declarations are to be trusted is counted from the same rows.

The text model is fitted on at most ``TRAIN_ROWS`` rows (of different ids) for each label, those whose ids hash lowest, and
each label is a class; priors, trust and everything else cover all rows.

Defined results
  * null texts and texts without a letter have no language: language null, posterior 0, rejected;
  * a declared language without a class stands, and is not rejected, where the text is ``UNLIKE`` that of every class: its
    evidence for each is so many standard deviations below what the class's own trigrams give; else it is evidence only;
  * a missing host or declaration adds no evidence; ``REJECT_BELOW`` rejects rows that no language explains better;
  * equal posteriors go to the language first in order of name; rows are judged one by one, repeated rows alike;
  * a label whose texts have no letter is no class beside others; an empty table gives an empty result; the text model cannot be fitted on rows without labels: an error;
  * a text's evidence is that of all its trigrams, tempered to the weight of ``MOST_GRAMS`` at most, so that priors and
    declarations still count for long texts;
  * :func:`keep` passes all columns through; helper columns have names that start with two underscores; :func:`identify`
    returns columns of its own named language, posterior and rejected, and takes none of these names, nor evidence or excess.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import hold, materialise, read, small_batches

#: Bound of the ids of each label that the text model is fitted on.
TRAIN_ROWS = 4000
BUCKETS = 1 << 16
SMOOTH = 0.5
#: Neighbouring trigrams repeat each other: a text counts as at most so many independent ones.  More of them would have any
#: long text outweigh priors and declarations however mixed it is; fewer would leave short texts to the priors.
MOST_GRAMS = 60
KAPPA = 20.0
REJECT_BELOW = 0.5
UNLIKE = 3.0
# Labels below which countries register names.
SECOND_LEVELS = ["ac", "co", "com", "edu", "gob", "gov", "gouv", "ltd", "net", "nom", "org", "or", "ne", "plc", "sch"]
#: Languages that a task counts before it lets go of their counts.
_HELD = 32
_PIECE = 1 << 20


def grams(text: str) -> np.ndarray:
    """A bucket for each byte trigram of the text in lower case, all white space and ASCII signs taken as one space."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of log-probabilities, a row for each bucket
    usual: np.ndarray  # mean and standard deviation of a language's own trigrams' log-probability, a column a language

    def read(self, text: str | None) -> tuple[list[float], float] | None:
        """The evidence, and by how much the text passes the least that a language's own text has, at the language that fits best."""
        g = grams(text) if text else grams("")
        if not len(g):
            return None
        total = np.zeros(len(self.languages))
        for at in range(0, len(g), _PIECE):
            total += self.table[g[at : at + _PIECE]].sum(0, dtype=np.float64)
        n = min(len(g), MOST_GRAMS)
        total *= n / len(g)
        least = n * self.usual[0] - UNLIKE * np.sqrt(n) * self.usual[1]
        return total.tolist(), float((total - least).max())

    def evidence(self, text: str | None) -> list[float] | None:
        found = self.read(text)
        return found and found[0]


def _cuts(usable: DataFrame, rows: int) -> DataFrame:
    """lang, cut: the hash up to which a label's ids are taken.  Most rows fall to a share of the hashes that is sure to
    leave enough, so no task ranks more than a bounded number of a label's ids."""
    share = F.col("h") / float(1 << 64) + 0.5
    distinct = usable.groupBy(F.col("lang").alias("l")).agg(F.approx_count_distinct("h").alias("n"))
    few = usable.join(F.broadcast(distinct), F.col("lang") == F.col("l")).where(share * F.col("n") <= 1.5 * rows + 64).select("lang", "h").distinct()
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= rows)
    return ranked.groupBy(F.col("lang").alias("l")).agg(F.max("h").alias("cut"))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, id: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Counts trigrams by language over the bounded sample; what reaches the driver is one row a language."""
    # Rows without an id count as rows of one id.
    key = F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")))
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("lang"), key.alias("h"), F.col(text).alias("text"))
    cuts = materialise(_cuts(usable.select("lang", "h"), rows), "cuts")
    sample = usable.join(F.broadcast(cuts), (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("cut"))).select("lang", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}

        def counted():
            for lang, c in totals.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([0, *c[at].tolist()], pa.int64())})

        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in totals and len(totals) >= _HELD:
                    yield from counted()
                    totals.clear()
                totals[lang] = totals.get(lang, 0) + np.bincount(grams(t), minlength=BUCKETS)
        yield from counted()

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_language = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).select("lang", F.col("x.bucket").alias("bucket"), F.col("x.n").alias("n")).toArrow().sort_by("lang")
    # A label without a letter in its texts has nothing to be read by; such labels are classes only where all are like that.
    lettered = pa.array([max(x) >= 0 for x in by_language["bucket"].to_pylist()], pa.bool_())
    by_language = by_language.filter(lettered) if any(lettered.to_pylist()) else by_language
    languages = by_language["lang"].to_pylist()
    if not languages:
        if not labelled.isEmpty():
            raise ValueError("no labelled rows to fit the text model on")
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((2, 0)))
    table, usual = np.empty((BUCKETS, len(languages)), np.float32), np.zeros((2, len(languages)))
    for i in range(len(languages)):
        own = np.zeros(BUCKETS)
        at, n = by_language["bucket"][i].values.to_numpy(), by_language["n"][i].values.to_numpy()
        own[at[at >= 0]] = n[at >= 0]
        logs = np.log((own + SMOOTH) / (own.sum() + SMOOTH * BUCKETS))
        table[:, i] = logs
        if own.any():
            share = own / own.sum()
            usual[0, i] = share @ logs
            usual[1, i] = np.sqrt(max(0.0, share @ logs**2 - usual[0, i] ** 2))
    return Model(languages, table, usual)


def evidence_column(spark, model: Model, text: Column) -> Column:
    """evidence: the text's tempered log-likelihoods in the order of the model's languages; excess: see ``Model.read``;
    null without a letter."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.table, model.usual))

    @F.arrow_udf("struct<evidence:array<double>,excess:double>")
    def evidence(texts: pa.Array) -> pa.Array:
        hold("language_id", lambda: None)
        m = Model(*shared.value)
        found = [m.read(t.as_py()) or (None, None) for t in texts]
        return pa.StructArray.from_arrays([pa.array([e for e, _ in found], pa.list_(pa.float64())), pa.array([x for _, x in found], pa.float64())], names=["evidence", "excess"])

    return evidence(text)


def host_levels(host: Column) -> list[Column]:
    """Suffix, registered domain and host of an address; a name without dots is its own domain and suffix.

    A suffix is the last label, with the one before it where that is a usual second level of a country (``co.uk``).
    """
    second = "|".join(SECOND_LEVELS)
    suffix = F.regexp_extract(host, f"((?:(?<![^.])(?:{second})\\.(?=[^.]{{2}}$))?[^.]*)$", 1)
    before = F.regexp_extract(F.left(host, F.length(host) - F.length(suffix)), "([^.]*\\.)$", 1)
    return [suffix, F.concat(before, suffix), host]


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int")


def priors(rows: DataFrame, n: int, kappa: float = KAPPA) -> DataFrame:
    """host, prior (log-probabilities): ``rows`` has host and evidence.  Counts are pre-aggregated by host, then rolled up."""
    levels = ["suffix", "domain", "host"]
    named = rows.where("host IS NOT NULL AND evidence IS NOT NULL").select("host", _argmax(F.col("evidence")).alias("best"))
    tallies = named.groupBy("host", "best").agg(F.count("*").alias("n"))
    tallies = materialise(tallies.select(*(x.alias(name) for x, name in zip(host_levels(F.col("host")), levels)), "best", "n"), "hosts")

    def summed(keys: list[str]) -> DataFrame:
        found = tallies.groupBy(*keys, "best").agg(F.sum("n").cast("double").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"))
        return found.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("counts"))

    def smoothed(counts: Column, above: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c)
        return F.transform(F.arrays_zip(counts.alias("c"), above.alias("p")), lambda x: (x["c"] + kappa * x["p"]) / (total + kappa))

    even = F.array_repeat(F.lit(1.0 / n), n)
    top = summed([]).select(smoothed(F.col("counts"), even).alias("p"))
    of_suffix = summed(["suffix"]).join(F.broadcast(top)).select("suffix", smoothed(F.col("counts"), F.col("p")).alias("p_suffix"))
    of_domain = summed(["suffix", "domain"]).join(of_suffix, "suffix").select("domain", smoothed(F.col("counts"), F.col("p_suffix")).alias("p_domain"))
    of_host = summed(levels).join(of_domain, "domain").select("host", smoothed(F.col("counts"), F.col("p_domain")).alias("p"))
    return materialise(of_host.select(F.col("host").alias("__host"), F.transform("p", F.ln).alias("__prior")), "priors")


def _known(languages: list[str]) -> Column:
    return F.when(F.col("declared").isin(languages), F.col("declared"))


def trust(rows: DataFrame, languages: list[str]) -> DataFrame:
    """__declared, __like: log-likelihood of the declared language under each language, from grouped counts of declared
    against read language.

    Declarations that name no known language count as one more value, null, so the counts are a bounded table.
    """
    n = len(languages)
    counts = rows.where("declared IS NOT NULL AND evidence IS NOT NULL").groupBy(_known(languages).alias("d"), _argmax(F.col("evidence")).alias("best")).agg(F.count("*").alias("n")).collect()
    values = [*languages, None]
    place = {v: i for i, v in enumerate(values)}
    c = np.ones((n + 1, n)) * 0.5
    for r in counts:
        c[place[r["d"]], r["best"] - 1] += r["n"]
    like = np.log(c / c.sum(0))
    return rows.sparkSession.createDataFrame(pa.table({"__declared": pa.array(values, pa.string()), "__like": pa.array(like.tolist(), pa.list_(pa.float64()))}))


def fuse(rows: DataFrame, prior_table: DataFrame, declared_like: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` (with host, declared, evidence, excess) and language, posterior, rejected."""
    n = len(languages)
    flat = F.array_repeat(F.lit(0.0), n)
    joined = rows.join(prior_table, F.col("host") == F.col("__host"), "left")
    joined = joined.join(F.broadcast(declared_like), F.col("declared").isNotNull() & _known(languages).eqNullSafe(F.col("__declared")), "left")
    logits = F.transform(F.arrays_zip(F.col("evidence").alias("e"), F.coalesce("__prior", flat).alias("p"), F.coalesce("__like", flat).alias("d")), lambda x: x["e"] + x["p"] + x["d"])
    out = joined.withColumn("__logits", logits)
    top = F.array_max("__logits")
    share = 1 / F.aggregate("__logits", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    names = F.array(*map(F.lit, languages))
    # The declared language against the class that fits best, at the least evidence that a language's own text has.
    stands = F.col("declared").isNotNull() & _known(languages).isNull() & (F.col("excess") < 0)
    posterior = F.when(stands, 1 / (1 + F.exp("excess"))).otherwise(F.coalesce(share, F.lit(0.0)))
    named = F.when(stands, F.col("declared")).when(F.col("evidence").isNotNull(), F.element_at(names, F.array_position("__logits", top).cast("int")))
    out = out.withColumns({"language": named, "posterior": posterior})
    return out.withColumn("rejected", F.col("posterior") < REJECT_BELOW).drop("__logits", "__host", "__prior", "__declared", "__like", "excess")


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` has text, host, declared and columns to keep; returns these but the text, with language, posterior, rejected."""
    if taken := {"language", "posterior", "rejected", "evidence", "excess"} & set(rows.columns):
        raise ValueError(f"columns that would be overwritten: {sorted(taken)}")
    if not model.languages:
        return rows.drop("text").withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(0.0), "rejected": F.lit(True)})
    seen = rows.withColumn("__read", evidence_column(rows.sparkSession, model, F.col("text"))).drop("text")
    seen = materialise(seen.select("*", "__read.*").drop("__read"), "evidence")
    return fuse(seen, priors(seen, len(model.languages)), trust(seen, model.languages), model.languages).drop("evidence")


def keep(docs: DataFrame, model: Model, host: str = "source", declared: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    A decision depends on text, host and declaration alone.  It is made on rows without text, which carry a key of 128 bits
    of these three; what is joined with the whole rows is the keys of rejected ones, broadcast while they are few.
    """
    if not model.languages:
        return docs.where(F.lit(False))
    names = {"host": F.col(host), "declared": F.lower(F.col(declared))}
    stated = [x for c in (text, host, declared) for x in (F.col(c), F.col(c).isNull())]
    key = lambda name: [F.xxhash64(*stated).alias(f"{name}1"), F.xxhash64(F.lit(1), *stated).alias(f"{name}2")]
    column = evidence_column(docs.sparkSession, model, F.col(text))
    seen = materialise(docs.select(*key("k"), *(c.alias(k) for k, c in names.items()), column.alias("__read")).select("k1", "k2", *names, "__read.*"), "evidence")
    fused = fuse(seen, priors(seen, len(model.languages)), trust(seen, model.languages), model.languages)
    gone = materialise(fused.where("rejected").select(F.col("k1").alias("__gone1"), F.col("k2").alias("__gone2")).distinct(), "rejected")
    k1, k2 = key("__k")
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(gone, (F.col("__k1") == F.col("__gone1")) & (F.col("__k2") == F.col("__gone2")), "left_anti").drop("__k1", "__k2")


def page_text(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "&[A-Za-z]+;|&#[0-9]+;", " ")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, host and declared language of raw web pages."""
    declared = F.lower(F.regexp_extract("html", "(?i)<html[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]+)", 1))
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    none = F.lit(None).cast("string")
    return pages.select("page_id", page_text(F.col("html")).alias("text"), F.when(host != "", host).otherwise(none).alias("host"), F.when(declared != "", declared).otherwise(none).alias("declared"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Documents: the source is the host, the column ``lang`` the declaration."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").alias("host"), F.lower("lang").alias("declared"))
    out = identify(rows, train(docs))
    return out.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "rejected", (~F.col("rejected")).alias("kept"))


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    """Web pages: address, markup language and text."""
    out = identify(page_rows(read(spark, sf_dir, "pages")), train(read(spark, sf_dir, "documents")))
    return out.select("page_id", "host", "declared", "language", F.round("posterior", 6).alias("posterior"), "rejected")
