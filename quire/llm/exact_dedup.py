"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks.  Each chunk gets a polynomial hash modulo two primes; the hashes of neighbouring chunks combine
by length-shifted arithmetic, ``h(ab) = h(a) * B^len(b) + h(b)``, so that chunks of one huge document can be hashed by
different tasks.  Documents with equal fingerprints are then compared chunk by chunk with the row that would stay.

Defined results
  * null text counts as empty; empty texts are equal to each other;
  * rows with a null ``doc_id`` take part, but a group stays with its smallest non-null id; if it has none, every row stays;
  * repeated rows stay repeated: each is returned, ``kept`` where its ``doc_id`` is the smallest of its group;
  * further columns of the input are ignored by :func:`assign` and returned untouched by :func:`keep_first`;
  * an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, hold, materialise, read, small_batches, text_or_empty

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 911382323)
#: Bytes of a chunk that is hashed by one product of vectors: 8 bits + 31 bits + 16 bits stay below 64.
CHUNK = 1 << 16
#: Characters beyond which a document's pieces are dealt to different tasks.
HUGE = 4 << 20
#: Characters of a piece that is compared at once.
PIECE = 1 << 16
#: Members of a group of copies that share one copy of the row that stays.
MEMBERS_PER_SALT = 2000

#: Bits that say which ids may be among some.  64 of them are a row, so that at most 2^18 rows are broadcast, whatever the table.
MARKS = 1 << 24

_POWERS: dict[int, np.ndarray] = {}


def _powers(which: int) -> np.ndarray:
    """``B^(CHUNK-1) .. B^0`` modulo the prime, made by doubling."""
    if which not in _POWERS:
        p, b = PRIMES[which], BASES[which]
        out = np.ones(1, dtype=np.uint64)
        while len(out) < CHUNK:
            out = np.concatenate([out, out * np.uint64(pow(b, len(out), p)) % np.uint64(p)])
        _POWERS[which] = np.ascontiguousarray(out[:CHUNK][::-1])
    return _POWERS[which]


def fingerprint(data: np.ndarray) -> tuple[int, int]:
    """Both hashes of the bytes ``data``, combined from its chunks."""
    out = []
    for which in (0, 1):
        p, b, powers, h = PRIMES[which], BASES[which], _powers(which), 0
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK].astype(np.uint64)
            h = (h * pow(b, len(part), p) + int(part @ powers[CHUNK - len(part) :]) % p) % p
        out.append(h)
    return out[0], out[1]


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds h1, h2, the bytes, and what h1 and h2 of a left neighbour are multiplied by."""
    hold("exact_dedup", _POWERS.clear)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("norm")).cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        pairs = [fingerprint(data[offsets[i] : offsets[i + 1]]) for i in range(n)]
        sizes = np.diff(offsets)
        rest = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != "norm"}
        yield pa.RecordBatch.from_pydict(
            rest
            | {
                "h1": pa.array([x for x, _ in pairs], pa.int64()),
                "h2": pa.array([x for _, x in pairs], pa.int64()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "s1": pa.array([pow(BASES[0], int(s), PRIMES[0]) for s in sizes], pa.int64()),
                "s2": pa.array([pow(BASES[1], int(s), PRIMES[1]) for s in sizes], pa.int64()),
            }
        )


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), f"{SPACE}+", " ")


def _pieces(text: Column, size: int) -> Column:
    """The text's pieces of ``size`` characters with their numbers; an empty text has one."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.named_struct(F.lit("no"), i, F.lit("piece"), F.substring(text, i * size + 1, F.lit(size))))


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """doc_id, text_sha256, h1, h2, n_bytes: a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    # Sizes are asked of the raw text, so that no filter normalises it once more.
    size = F.coalesce(F.length("text"), F.lit(0))
    described = lambda rows: rows.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    out = "h1 long, h2 long, n_bytes long, s1 long, s2 long"
    small = described(docs.where(size <= huge)).select("doc_id", "text_sha256", "norm")
    whole = small.mapInArrow(_hash_batches, f"doc_id long, text_sha256 string, {out}").select("doc_id", "text_sha256", "h1", "h2", "n_bytes")
    # The row number only tells rows apart that may agree in every column; file scans give it alike on each attempt.
    large = described(docs.where(size > huge)).withColumn("row", F.monotonically_increasing_id())
    parts = large.select("row", "doc_id", "text_sha256", F.explode_outer(_pieces(F.col("norm"), huge // 4 + 1)).alias("x"))
    parts = parts.select("row", "doc_id", "text_sha256", F.col("x.no").alias("no"), F.col("x.piece").alias("norm")).repartition("row", "no")
    hashed = parts.mapInArrow(_hash_batches, f"row long, doc_id long, text_sha256 string, no int, {out}")
    folded = hashed.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("no", "h1", "h2", "n_bytes", "s1", "s2"))).alias("parts"))

    def combined(h: str, shift: str, prime: int) -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[shift] + x[h]) % F.lit(prime))

    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["n_bytes"])
    combined_rows = folded.select("doc_id", "text_sha256", combined("h1", "s1", PRIMES[0]).alias("h1"), combined("h2", "s2", PRIMES[1]).alias("h2"), total.alias("n_bytes"))
    return whole.unionByName(combined_rows)


PRINT = ["h1", "h2", "n_bytes"]


def marked(rows: DataFrame, ids: DataFrame, id: str = "doc_id", marks: int = MARKS) -> DataFrame:
    """``rows`` with __marked: false only where the id is not among ``ids`` (column id).  Neither side's texts are moved for it.

    Ids that share a bit are marked as well, so what is marked is joined with the ids themselves; the table of bits stays as
    small as it is, and in a collection with more ids than bits, all of them are marked.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(marks))
    bit = lambda c: slot(c).bitwiseAND(63).cast("int")
    words = ids.select(F.shiftright(slot("id"), 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit("id")).alias("bit"))
    words = words.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    found = rows.join(F.broadcast(words), F.shiftright(slot(id), 6) == F.col("__word"), "left")
    return found.withColumn("__marked", F.coalesce(F.getbit("__bits", bit(id)) == 1, F.lit(False))).drop("__word", "__bits")


def differing(docs: DataFrame, prints: DataFrame, piece: int = PIECE, members_per_salt: int = MEMBERS_PER_SALT) -> DataFrame:
    """doc_id, text_sha256 of rows whose fingerprint equals that of their group's first row, but not their text.

    The first row's pieces are copied once for each ``members_per_salt`` members, so that a group that holds a large share
    of all rows is compared by many tasks.
    """
    first = F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("id"), "doc_id", "text_sha256")).alias("first")
    groups = prints.groupBy(*PRINT).agg(first, F.count("*").alias("size")).where("size > 1")
    groups = groups.select(*PRINT, "first", F.ceil(F.col("size") / members_per_salt).cast("int").alias("salts"))
    members = prints.join(groups, PRINT).select("doc_id", "text_sha256", *PRINT, "first", "salts").distinct()
    leads = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_sha256") == F.col("first.text_sha256"))
    salt = F.when(leads, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "text_sha256"), F.col("salts")).cast("int")))
    members = materialise(members.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), *PRINT, leads.alias("leads"), salt.alias("salt")), "members")
    # Only texts that may be a member's are read closely and shuffled.
    of_members = marked(docs.select("doc_id", "text"), members.select("id")).where("__marked")
    texts = of_members.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    # Repeated rows of one id and text need one comparison: the join on both keeps them apart from other texts of that id.
    # Null-safe on both, or the planner would hash every text once more to find that its hash is not null.
    # Merged at every size, as a group's texts meet below in any case: members are a share of the table, not a fixed number.
    rows = texts.join(members.hint("merge"), F.col("text_sha256").eqNullSafe(F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("id")))
    # Neither array is ever empty; an inner explode would have the planner ask for that before the join, text by text.
    rows = rows.select("doc_id", "text_sha256", *PRINT, "leads", F.explode_outer("salt").alias("salt"), _pieces(F.col("norm"), piece).alias("pieces"))
    rows = rows.select("doc_id", "text_sha256", *PRINT, "leads", "salt", F.explode_outer("pieces").alias("x")).select("*", "x.no", "x.piece").drop("x")
    keys = [*PRINT, "salt", "no"]
    lead = rows.where("leads").select(*keys, F.col("piece").alias("lead_piece"))
    others = rows.where("NOT leads").select("doc_id", "text_sha256", *keys, "piece")
    return others.join(lead, keys, "left").where(~F.col("piece").eqNullSafe(F.col("lead_piece"))).select("doc_id", "text_sha256").distinct()


def assign(docs: DataFrame, huge: int = HUGE, piece: int = PIECE, members_per_salt: int = MEMBERS_PER_SALT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``."""
    prints = materialise(fingerprints(docs, huge), "fingerprints")
    odd = materialise(differing(docs, prints, piece, members_per_salt), "differing")
    odd = odd.select(F.col("doc_id").alias("odd_id"), F.col("text_sha256").alias("odd_sha"))
    same = (F.col("text_sha256") == F.col("odd_sha")) & F.col("doc_id").eqNullSafe(F.col("odd_id"))
    # Rows that only share a fingerprint form groups of their own.
    rows = prints.join(odd, same, "left").withColumn("own", F.coalesce("odd_sha", F.lit(""))).drop("odd_id", "odd_sha")
    keys = [*PRINT, "own"]
    groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(groups, keys).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated equal rows with one id, one stays.

    Only rows whose id may be one that goes, or is repeated, are joined with these; all others pass as the scan reads them.
    """
    decided = assign(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.bool_and("kept").alias("__kept"), F.count("*").alias("__rows"))
    special = materialise(decided.where("NOT __kept OR (__rows > 1 AND __id IS NOT NULL)").select("__id", "__sha", "__kept"), "special")
    split = marked(docs, special.select(F.col("__id").alias("id")))
    rows = split.where("__marked").drop("__marked").withColumn("__text_sha", F.sha2(normalised(), 256))
    of = F.col("__text_sha").eqNullSafe(F.col("__sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    out = rows.join(special, of, "left_anti")
    repeated = special.where("__kept")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, of, "left_semi").dropDuplicates(["doc_id", "__text_sha"]))
    return split.where("NOT __marked").drop("__marked").unionByName(out.drop("__text_sha"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
