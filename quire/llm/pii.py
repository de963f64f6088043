"""Personal data by bootstrapped contextual extraction.

Base patterns find emails, addresses of hosts, cards and phones; these are the seeds.  The words around seeds are lexical
patterns.  Spark scores the graph of patterns and instances in rounds: a pattern is as good as the share of its instances that
are seeds or believed; an instance that no base pattern finds is believed as far as its patterns are good.  Instances that
reach ``ACCEPT``, through patterns that ``SUPPORT`` different seeds and more induced, are identifiers too, wherever they occur,
and induce patterns of the next round as seeds do.  An instance is a marked word, or a run of numbers on one line.

Base spans are leftmost and do not overlap within a kind; matches that fail their test are dropped without a retry.
Spans that the method adds never overlap a base span and never change the base counts.

Defined results
  * null and empty texts have no spans; texts are read whole; positions count code points, ends are exclusive;
  * rows are told apart by position in the table, so null and repeated ``doc_id`` are returned row by row;
  * a run is the longest one, of 7 to 19 digits; a word within a run is added only where the run is not;
  * ties between kinds of an added instance go to the kind listed first; an empty table gives an empty result;
  * further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hold, materialise, read, slices, small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
SMOOTH = 1.0
ACCEPT = 0.75
#: Characters of a neighbouring word that count: the nearest ones.  Words are looked for within three times as many.
CONTEXT = 80

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can start within a run of digits: it would have started at the run's first.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]|[(\[]at[)\]]")
WORD = re.compile(r"\S+")
#: Numbers of one line joined by space, dash, dot or brackets.
RUN = re.compile(r"(?<!\w)[+(\[]{0,2}(?<!\w)[0-9]+(?:[ .()\[\]-]{1,2}[0-9]+)+(?!\w)")
EDGE = ".,;:!?()[]{}<>\"'*#&$%"
#: What an added instance of each kind must look like.
SHAPES = {"email": r"@|[(\[]at[)\]]", "ip": r"^[0-9a-f]*[.:][0-9a-f]*[.:][0-9a-f.:]+$", "card": r"^([^0-9]?[0-9]){12,}[^0-9]?$", "phone": r"^[^0-9]{0,2}([0-9][^0-9]{0,2}){7,15}$"}


def emails(text: str) -> list[tuple[int, int]]:
    """Walks from one ``@`` to the next, so that long runs of word characters are read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(2, *m.span()) for m in CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def _word(word: str) -> str:
    return re.sub("[0-9]+", "0", word.lower().strip(EDGE))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: two words to the left, and a word on either side.

    Words shorter than ``CONTEXT`` are whole; of a longer one the nearest so many characters count, and nothing beyond it.
    """
    reach = 3 * CONTEXT
    left = [w[-CONTEXT:] for w in text[max(0, start - reach) : start].split()[-2:]]
    if left and len(left[-1]) == CONTEXT:
        left = left[-1:]
    right = [w[:CONTEXT] for w in text[end : end + reach].split()[:1]]
    l2, l1, r1 = [""] * (2 - len(left)) + [*map(_word, left)] + ([*map(_word, right)] or [""])
    return [f"{l2} {l1} _", f"{l1} _ {r1}"]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of numbers with a space, beside the base spans."""
    out, at = [], 0
    for a, b in [*taken, (len(text), len(text))]:
        out += [m.span() for m in RUN.finditer(text, at, a) if " " in m[0] and 7 <= len(_digits(m[0])) <= 19]
        at = max(at, b)
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds with their kind, and other marked words and runs with the empty kind; ``outer`` is the start of the run that
    holds a word, or -1."""
    out = [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b].lower(), "contexts": contexts(text, a, b), "outer": -1} for k, a, b in base]
    taken = merged([(a, b) for _, a, b in base])
    joined = runs(text, taken)
    out += [{"kind": "", "start": a, "end": b, "value": text[a:b].lower(), "contexts": contexts(text, a, b), "outer": -1} for a, b in joined]
    i = j = 0
    for m in WORD.finditer(text):
        if not MARKED.search(m[0]):
            continue
        a, b = m.start() + len(m[0]) - len(m[0].lstrip(EDGE)), m.end() - len(m[0]) + len(m[0].rstrip(EDGE))
        while j < len(joined) and joined[j][1] <= a:
            j += 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b - a >= 5 and not (i < len(taken) and taken[i][0] < b):
            outer = joined[j][0] if j < len(joined) and joined[j][0] < b else -1
            out.append({"kind": "", "start": a, "end": b, "value": text[a:b].lower(), "contexts": contexts(text, a, b), "outer": outer})
    return out


_MENTION = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("contexts", pa.list_(pa.string())), ("outer", pa.int32())])
_BASE = pa.struct([("place", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold("pii", lambda: None)
    for batch in slices(batches):
        spans, found = [], []
        for t in batch.column(2):
            text = t.as_py()
            own = base_spans(text)
            spans.append([{"place": k, "start": a, "end": b} for k, a, b in own])
            found.append(mentions(text, own) if MARKED.search(text) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_BASE)), pa.array(found, pa.list_(_MENTION))], names=["row", "doc_id", "base", "mentions"])


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans and mentions of every text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    span = "array<struct<place:int,start:int,end:int>>"
    return rows.mapInArrow(_scan, f"row long, doc_id long, base {span}, mentions array<struct<kind:string,start:int,end:int,value:string,contexts:array<string>,outer:int>>")


def discover(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """value, kind of the instances that the patterns of seeds, and of instances accepted by them, make identifiers; ``found``
    has kind, value, contexts, outer.  Words within runs do not count again among what a pattern holds."""
    edges = found.select("kind", "value", "outer", F.explode("contexts").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.count("*").alias("n"), F.count_if(F.col("outer") < 0).alias("whole"))
    edges = materialise(edges, "pattern-instances")
    totals = edges.groupBy("pattern").agg(F.sum("whole").alias("total"))
    seeds = edges.where("kind <> ''").groupBy("pattern", "kind").agg(F.sum("n").alias("seeds"), F.count("*").alias("values"))
    open_edges = edges.where("kind = ''").select(F.col("pattern").alias("p"), "value", "n")
    looks = F.lit(False)
    for kind, shape in SHAPES.items():
        looks = looks | ((F.col("kind") == kind) & F.col("value").rlike(shape))

    def held(counted: DataFrame) -> DataFrame:
        patterns = materialise(counted.where(F.col("values") >= support).join(totals, "pattern"), "patterns")
        graph = open_edges.join(patterns, F.col("p") == F.col("pattern")).select("pattern", "kind", "value", "n", "seeds", "total")
        return materialise(graph.where(looks), "graph")

    def believed(scored: DataFrame) -> DataFrame:
        doubt = F.sum(F.ln(1 - F.least(F.col("score"), F.lit(0.999))))
        return scored.groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("belief"))

    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))

    def accepted(scored: DataFrame) -> DataFrame:
        return believed(scored).where(F.col("belief") >= accept).groupBy("value").agg(F.max_by("kind", F.struct("belief", -place)).alias("kind"))

    scored = held(seeds).withColumn("score", F.col("seeds") / (F.col("total") + SMOOTH))
    for _ in range(rounds - 1):
        own = accepted(scored).select(F.col("value").alias("v"), "kind")
        induced = open_edges.join(own, F.col("value") == F.col("v")).groupBy(F.col("p").alias("pattern"), "kind").agg(F.lit(0).cast("long").alias("seeds"), F.count("*").alias("values"))
        graph = held(seeds.unionByName(induced).groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"), F.sum("values").alias("values")))
        beliefs = believed(scored).select(F.col("value").alias("v"), F.col("kind").alias("k"), "belief")
        own = graph.join(beliefs, (F.col("value") == F.col("v")) & (F.col("kind") == F.col("k")))
        gained = own.groupBy(F.col("pattern").alias("gp"), F.col("kind").alias("gk")).agg(F.sum(F.col("n") * F.col("belief")).alias("gain"))
        scored = graph.join(gained, (F.col("pattern") == F.col("gp")) & (F.col("kind") == F.col("gk")), "left")
        scored = materialise(scored.select(*graph.columns, ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("total") + SMOOTH)).alias("score")), "scored")
    return accepted(scored)


def _joined(spans: Column) -> Column:
    name = lambda place: F.element_at(F.array(*map(F.lit, KINDS)), place + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: arrays of (place, start, end), by kind and then start; a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = materialise(scan(docs), "scanned")
    found = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    new = discover(found).withColumnsRenamed({"value": "v", "kind": "k"})
    place = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("k")) - 1).cast("int")
    added = found.where("kind = ''").join(new, F.col("value") == F.col("v")).groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct(place.alias("place"), "start", "end", "outer")).alias("added"))
    # A word goes where the run that holds it is added.
    starts = F.transform(F.filter("added", lambda s: s["outer"] < 0), lambda s: s["start"])
    rest = F.filter("added", lambda s: (s["outer"] < 0) | ~F.array_contains("__starts", s["outer"]))
    added = added.withColumn("__starts", starts).select("r", F.array_sort(F.transform(rest, lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end")))).alias("added"))
    none = F.array().cast("array<struct<place:int,start:int,end:int>>")
    return rows.join(added, F.col("row") == F.col("r"), "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _of_kind(place: int) -> Column:
    return F.filter("base", lambda s: s["place"] == place)


def digests(spans: DataFrame) -> DataFrame:
    counts = [F.size(_of_kind(i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    everything = F.array_sort(F.concat("base", "added"))
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(everything).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return digests(find(read(spark, sf_dir, "documents")))
