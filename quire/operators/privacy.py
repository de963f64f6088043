"""Stable pseudonyms: find identifiers, number them, rewrite texts, and turn them back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx

# Kinds of identifier in the order in which they are replaced, and what they look like.
IDENTIFIERS = {
    "CPF": r"\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b",
    "CNPJ": r"\b[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}\b",
    "EMAIL": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "IP": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "PHONE": r"\+[0-9][0-9 ().-]{7,17}[0-9]",
    "TEL": r"(?<![0-9])(?:\(?[0-9]{2}\)?\s?)?(?:9\s?)?[0-9]{4}[-\s][0-9]{4}(?![0-9])",
    "PLATE": r"\b[A-Z]{3}-?[0-9][A-Z0-9][0-9]{2}\b",
    "POSTCODE": r"[0-9]{5}-[0-9]{3}",
    "SERIAL": r"[0-9]{15,16}",
    "RG": r"(?i:(?<=\bRG\s)\s*n?[ºo°.]?\s*:?\s*[0-9]{1,2}\.?[0-9]{3}\.?[0-9]{3}-?[0-9X]?\b|(?:(?<=\bRG n[ºo°] )|(?<=\bRG n[ºo°]: )|(?<=\bRG: )|(?<=\bRG ))[0-9]{5,14}\b)",
}
#: Numbers that look like identifiers and are none; they are kept aside while the others are replaced.
SHIELDED = [r"[0-9]{7}-[0-9]{2}\.[0-9]{4}\.[0-9]\.[0-9]{2}\.[0-9]{4}", r"Num\.\s*[0-9]+", r"[0-9]{20,}"]
#: As the finder takes them: letters with marks belong to an address too.
PATTERNS = IDENTIFIERS | {"EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"}
_RG = re.compile(r"(?i)\bRG[\s:]")


def _any(left_out: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join([f"(?P<S{i}>{p})" for i, p in enumerate(SHIELDED)] + [f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k not in left_out]))


_ANY = {x: _any(x) for x in [(), ("EMAIL",), ("RG",), ("EMAIL", "RG")]}


def _matches(text: str):
    """Matches of all kinds; the two slow patterns are left out where the text lacks what each of their matches holds."""
    return _ANY[("EMAIL",) * ("@" not in text) + ("RG",) * (_RG.search(text) is None)]

# Roles that follow a name on a cover, and words that no person's name holds.
ROLES = r"R[ÉE]U?S?|AUTORA?|ADVOGAD[OA]|V[ÍI]TIMA|TESTEMUNHA|INVESTIGAD[OA]|APELANTE|APELAD[OA]|RECORRENTE|RECORRID[OA]|PACIENTE|IMPETRANTE|REQUERENTE|REQUERID[OA]"
INSTITUTION_WORDS = {"TRIBUNAL", "JUSTICA", "MINISTERIO", "PUBLICO", "PUBLICA", "ESTADO", "ESTADUAL", "FEDERAL", "VARA", "COMARCA", "PODER", "JUDICIARIO", "SECRETARIA", "PROMOTORIA", "DEFENSORIA", "POLICIA", "CIVIL", "MILITAR", "DELEGACIA", "INSTITUTO", "NACIONAL", "GOVERNO", "MUNICIPIO", "UNIAO"}
PARTICLES = {"DE", "DA", "DO", "DOS", "DAS", "E"}
CAPITALS = "A-ZÁÉÍÓÚÂÊÔÃÕÇÜ"


def find_identifiers(text: str) -> list[tuple[str, str]]:
    """(kind, value) in order; at one place the kind listed first, and nothing within a shielded number."""
    return [(m.lastgroup, m[0]) for m in _matches(text).finditer(text) if m.lastgroup in IDENTIFIERS]


def replace_identifiers(text: str, tokens: dict[str, str]) -> str:
    return _matches(text).sub(lambda m: tokens.get(m[0], m[0]) if m.lastgroup in IDENTIFIERS else m[0], text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])))
def identifiers(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"kind": k, "value": v} for k, v in find_identifiers(t)] if t else [])


def identifier_values(docs: DataFrame, id: str, text: str, kinds: list[str]) -> DataFrame:
    """id, kind, pos, value of some kinds, each looked for on its own, without leaving the JVM."""
    arrays = [F.transform(F.regexp_extract_all(F.col(text), F.lit(IDENTIFIERS[k]), F.lit(0)), lambda v, k=k: v) for k in kinds]
    parts = [docs.select(id, F.lit(k).alias("kind"), F.posexplode(a).alias("pos", "value")) for k, a in zip(kinds, arrays)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cover_parties(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, name, role: a name in capitals and its role in brackets on one line; institutions are left out."""
    pattern = f"(?m)^[ \\t]*([{CAPITALS}][{CAPITALS}' \\t.-]{{4,80}}?)[ \\t]*\\(({ROLES})\\)[ \\t]*$"
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("role"))
    rows = docs.select(id, F.posexplode(zipped).alias("pos", "x")).select(id, "pos", tx.squeeze(F.col("x.name")).alias("name"), F.col("x.role").alias("role"))
    words = F.array_except(F.split(F.upper(tx.fold_same_length(F.col("name"))), " "), F.array(*map(F.lit, sorted(PARTICLES))))
    return rows.where((F.size(words) >= 2) & ~F.arrays_overlap(words, F.array(*map(F.lit, sorted(INSTITUTION_WORDS)))))


def witnesses(docs: DataFrame, id: str, text: str, tolerated: int = 2) -> DataFrame:
    """id, name: names that begin the lines after the heading of a list of witnesses, up to a line that ends it, or until
    more than ``tolerated`` lines in a row begin with no name."""
    after = F.regexp_extract(text, r"(?is)ROL\s+DE\s+TESTEMUNHAS?[:\s]*\n(.*)", 1)
    lines = docs.select(id, F.posexplode(F.split(after, "\n", -1)).alias("n", "line")).select(id, "n", F.trim("line").alias("line")).where("line <> ''")
    name = F.trim(F.regexp_extract("line", f"^([{CAPITALS}]{{2,}}(?:[ \\t]+[{CAPITALS}]{{1,}}){{1,7}})(?![a-zà-ÿ])", 1))
    words = F.array_except(F.split(F.upper(tx.fold_same_length(name)), r"\s+"), F.array(*map(F.lit, sorted(PARTICLES))))
    is_name = (name != "") & F.size(words).between(2, 6) & ~F.arrays_overlap(words, F.array(*map(F.lit, sorted(INSTITUTION_WORDS))))
    w = Window.partitionBy(id).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("line").rlike(r"(?i)^(DENUNCIAD|ACUSAD|R[ÉE]U\b|COTA\b|MM)")
    rows = lines.withColumns({"name": name, "__is": is_name, "__end": F.max(ends.cast("int")).over(w)}).withColumn("__named", F.sum(F.col("__is").cast("int")).over(w))
    # Lines without a name since the last one with a name; once there are too many, nothing after them counts.
    run = F.sum((~F.col("__is")).cast("int")).over(Window.partitionBy(id, "__named").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__run", run).withColumn("__stop", F.max((F.col("__run") > tolerated).cast("int")).over(w))
    return rows.where("__is AND __end = 0 AND __stop = 0").select(id, "n", "name")


def suggestions(docs: DataFrame, text: str) -> DataFrame:
    """name, n: names in capitals and how often they occur."""
    pattern = f"[{CAPITALS}]{{2,}}(?:[ \\t]+(?:(?:DE|DA|DO|DOS|DAS|E)[ \\t]+)?[{CAPITALS}]{{2,}}){{1,5}}"
    rows = docs.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("name"))
    words = F.array_except(F.split(F.upper(tx.fold_same_length(F.col("name"))), r"\s+"), F.array(*map(F.lit, sorted(PARTICLES))))
    return rows.where((F.size(words) >= 2) & ~F.arrays_overlap(words, F.array(*map(F.lit, sorted(INSTITUTION_WORDS))))).groupBy("name").agg(F.count("*").alias("n"))


def assign_tokens(values: DataFrame, case: list[str], order: list[str]) -> DataFrame:
    """case, kind, value, token: numbered within case and kind by first occurrence, so any split of the input numbers alike."""
    first = values.groupBy(*case, "kind", "value").agg(F.min(F.struct(*order)).alias("__first"))
    n = F.row_number().over(Window.partitionBy(*case, "kind").orderBy("__first", "value"))
    return first.select(*case, "kind", "value", F.concat_ws("_", "kind", n.cast("string")).alias("token"))


def extend_tokens(known: DataFrame, values: DataFrame, case: list[str], order: list[str]) -> DataFrame:
    """The table of tokens with those of new values, whose numbers go on after the known ones."""
    keys = [*case, "kind", "value"]
    new = values.join(known.select(*keys), keys, "left_anti")
    top = known.groupBy(*case, "kind").agg(F.max(F.regexp_extract("token", r"(\d+)$", 1).cast("int")).alias("__top"))
    numbered = assign_tokens(new, case, order).join(top, [*case, "kind"], "left")
    token = F.concat_ws("_", "kind", (F.regexp_extract("token", r"(\d+)$", 1).cast("int") + F.coalesce("__top", F.lit(0))).cast("string"))
    return known.select(*keys, "token").unionByName(numbered.select(*keys, token.alias("token")))


@F.pandas_udf(T.StringType())
def _rewrite(text: pd.Series, values: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else replace_identifiers(t, dict(zip(v, k))) if v is not None else t for t, v, k in zip(text, values, tokens)], dtype=object)


def pseudonymize(docs: DataFrame, tokens: DataFrame, case: list[str], id: str, text: str) -> DataFrame:
    """``docs`` with rewritten ``text``.  Each document meets only the tokens of its own values, however large the table is."""
    own = docs.select(F.col(id).alias("__id"), *case, F.explode(F.array_distinct(identifiers(F.col(text)))).alias("x")).select("__id", *case, "x.*")
    found = own.join(tokens, [*case, "kind", "value"]).groupBy("__id").agg(F.collect_list(F.struct("value", "token")).alias("m"))
    rows = docs.join(found, F.col(id) == F.col("__id"), "left")
    return rows.withColumn(text, _rewrite(F.col(text), F.col("m.value"), F.col("m.token"))).drop("__id", "m")


_TOKEN = re.compile("([A-Z]+)(_[0-9]+)")


@F.pandas_udf(T.StringType())
def _restore(text: pd.Series, tokens: pd.Series, values: pd.Series) -> pd.Series:
    def one(t, ks, vs):
        if t is None or ks is None:
            return t
        table = dict(zip(ks, vs))

        def back(m):
            # The longest ending that is a token: what stood before it may have been letters.
            i = next((i for i in range(len(m[1])) if m[0][i:] in table), None)
            return m[0] if i is None else m[0][:i] + table[m[0][i:]]

        return _TOKEN.sub(back, t)

    return pd.Series([one(*x) for x in zip(text, tokens, values)], dtype=object)


def restore(docs: DataFrame, tokens: DataFrame, case: list[str], id: str, text: str) -> DataFrame:
    """The inverse of :func:`pseudonymize`; whole numbers only, so that ``EMAIL_12`` is never read as ``EMAIL_1``."""
    endings = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Z]+_[0-9]+"), F.lit(0)), lambda x: F.transform(F.sequence(F.lit(1), F.instr(x, "_") - 1), lambda i: F.substr(x, i)))
    own = docs.select(F.col(id).alias("__id"), *case, F.explode(F.array_distinct(F.flatten(endings))).alias("token"))
    found = own.join(tokens, [*case, "token"]).groupBy("__id").agg(F.collect_list(F.struct("value", "token")).alias("m"))
    rows = docs.join(found, F.col(id) == F.col("__id"), "left")
    return rows.withColumn(text, _restore(F.col(text), F.col("m.token"), F.col("m.value"))).drop("__id", "m")


def name_pattern(name: str) -> str:
    """A pattern for a name in any case, with or without marks, with any white space between its words."""
    letters = {}
    for a, b in zip(tx.FOLD_FROM, tx.FOLD_TO):
        letters.setdefault(b.lower(), set()).update({a.lower(), a.upper()} if len(a.upper()) == 1 else {a})
    folded = name.translate(str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)).lower()
    one = lambda c: "[" + re.escape(c) + re.escape(c.upper()) + "".join(sorted(letters.get(c, ()))) + "]" if c.isalpha() else re.escape(c)
    return r"(?<![\p{L}])" + r"\s+".join("".join(map(one, w)) for w in folded.split()) + r"(?![\p{L}])"


def replace_names(text, names: list[tuple[str, str]]):
    """Replaces names by tokens, longest first, then the last two words of names of three and more.  ``names`` is one case's."""
    for name, token in sorted(names, key=lambda x: -len(x[0])):
        text = F.regexp_replace(text, name_pattern(name), token)
        if len(name.split()) >= 3:
            text = F.regexp_replace(text, name_pattern(" ".join(name.split()[-2:])), token)
    return text
