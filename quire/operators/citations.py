"""Citations of precedents, laws, bulletins and acts in running text, and the search for them in collections.

A form of citation is a row of parts: names, a number, what the number belongs to.  The names are stated below as data, and
:func:`_form` puts the parts together.  Texts are read without marks, letter for letter, so that one spelling of each
name is enough and positions are those of the original.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.relational import at_most
from quire.operators.spans import spans

# Names as citations write them, without marks.
COURTS = ["STJ", "STF", "TST", "TSE"]
HIGH_COURTS = ["STJ", "STF"]
LAWS = [
    "Codigo Penal", "Codigo de Processo Penal", "Codigo Civil", "Codigo de Processo Civil", "Constituicao", "Constituicao Federal", "Lei de Execucao Penal",
    "CP", "CPP", "CC", "CPC", "CF", "CRFB", "LEP", "CTN", "EAOAB", "LINDB", "LGPD", "CADH", "PIDCP",
]
CLASSES = ["ADC", "ADI", "ADPF", "AP", "ARE", "AREsp", "AgInt", "AgRg", "CC", "EREsp", "ExtR", "HC", "Inq", "MS", "Pet", "RE", "REsp", "RHC", "RMS", "Rcl", "RvCr"]
APPEALS = ["AgInt", "AgRg", "EDcl"]
ARTICLE_WORDS = ["art", "arts", "artigo", "artigos"]
PAGE_WORDS = ["fl.", "fls.", "folha", "folhas", "p.", "pag", "pag.", "pagina", "paginas"]


def _names(names: list[str]) -> str:
    """Any of several names, the longest first, with any white space inside."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return "(?:" + "|".join(r"\s+".join(re.escape(w) for w in n.split()) for n in ordered) + ")"


def _group(part: str) -> str:
    return f"({part})"


def _maybe(*parts: str) -> str:
    return f"(?:{''.join(parts)})?"


_GAP = r"\s*"
_SIGN = _maybe("n", "[.º°o]{0,2}", _GAP)
_LAW = f"(?:{_names(LAWS)}|Lei{_GAP}{_SIGN}" + r"[0-9]{1,2}\.?[0-9]{3}(?:/[0-9]{2,4})?)"
#: Topics and cases are numbered on without end; dots part their thousands.
_NUMBER = r"[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+(?![0-9])"
_ARTICLE_NUMBER = r"[0-9]{1,4}(?:-[A-Z](?![A-Za-z]))?"
#: What may stand between an article's number and its law: its paragraphs, items and letters.
_SUBDIVISION = "(?:" + "|".join([r"§{1,2}\s*[0-9]+\s*[ºo°]?", r"paragrafo\s+unico", "caput", r"(?:inc(?:iso)?\.?\s*)?[IVXLC]+", r"alinea\s+[a-z]"]) + r")(?![a-z])"


def _digits(most: int) -> str:
    return f"[0-9]{{1,{most}}}(?![0-9])"


def _belongs(names: list[str]) -> str:
    """A court after a number: ``7/STJ``, ``7 do STJ``, ``7, STJ``."""
    return _maybe(_GAP, "(?:/|-|,|d[aoe])?", _GAP, _group(_names(names)), "(?![A-Za-z])")


@dataclass(frozen=True)
class Form:
    kind: str
    pattern: str
    #: The groups that hold number, scope and part; 0 where the form has none.
    number: int = 1
    scope: int = 0
    part: int = 0


def _form(kind: str, *parts: str, cased: bool = False, number: int = 1, scope: int = 0, part: int = 0) -> Form:
    whole = "".join(parts)
    # Every form has three groups, so that all are read alike.
    missing = 3 - re.compile(whole).groups
    return Form(kind, ("" if cased else "(?i)") + whole + "()" * missing, number, scope, part)


_WORD = r"(?<![A-Za-z0-9])"

FORMS = [
    _form("BINDING", _WORD, _names(["Sumula Vinculante", "SV"]), _GAP, _SIGN, _group(_digits(3))),
    _form("PRECIS", _WORD, "Sumula", _GAP, _SIGN, _group(_digits(4)), _belongs(COURTS), r"(?!\s*Vinculante)", scope=2),
    _form("PRECIS", _WORD, _group(_names(HIGH_COURTS)), _GAP, ",?", _GAP, "Sumula", _GAP, _SIGN, _group(_digits(4)), number=2, scope=1),
    _form("TOPIC", _WORD, "Tema", _GAP, _maybe(r"de\s+repercussao\s+geral", _GAP), _SIGN, _group(_NUMBER), _belongs(HIGH_COURTS), scope=2),
    _form(
        "ARTICLE", _WORD, _names(ARTICLE_WORDS), r"\.?", _GAP, _group(_ARTICLE_NUMBER), "(?![0-9])", r"\s*[º°]?", f"(?:{_GAP},?{_GAP}{_SUBDIVISION}){{0,3}}",
        _maybe(_GAP, ",?", _GAP, _maybe("d[aoe]s?", _GAP), _group(_LAW), "(?![A-Za-z])"), scope=2,
    ),
    _form("ARTICLE", _WORD, _group(_LAW), r"\s*,\s*", _names(ARTICLE_WORDS), r"\.?", _GAP, _group(_ARTICLE_NUMBER), "(?![0-9])", number=2, scope=1),
    _form(
        "PRECEDENT", _WORD, _group(_maybe(_names(APPEALS), r"\s+n[oa]s?\s+") + _names(CLASSES)), r"\.?", _GAP, _SIGN, _group(r"[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{4,}"), "(?![0-9])",
        _maybe(r"\s*[-/]\s*", _group("[A-Z]{2}"), "(?![A-Za-z])"), number=2, scope=1, part=3,
    ),
    _form("BULLETIN", _WORD, _names(["Informativo", "Inf"]), r"\.?", _GAP, _SIGN, _group(_digits(4)), _belongs(HIGH_COURTS), scope=2),
    _form("ANCHOR", r"\[ID", _GAP, _group("[0-9]+|-"), r"\s*\|\s*", _group(r"[\w-]*"), r"\s*p\.\s*", _group("[0-9]+"), r"[^\]\n]*\]?", cased=True, scope=2, part=3),
    _form("ACT_ID", _WORD, _names(["ID", "Id", "Id.", "Num", "Num."]), _GAP, _SIGN, _group("[0-9]{6,12}(?![0-9])"), cased=True),
    _form("ACT_PAGE", _WORD, _names(PAGE_WORDS), _GAP, _group(_digits(4)), _maybe(r"\s*[-–/]\s*", _group(_digits(4))), part=2),
]
#: A citation of the first kind that begins inside one of the second is part of it.
WITHIN = {"PRECIS": ["BINDING"], "ACT_ID": ["ANCHOR"], "ACT_PAGE": ["ANCHOR"]}


def without_marks(text: Column) -> Column:
    """The letters without their marks, one for one; case stays."""
    return F.translate(text, tx.FOLD_FROM, tx.FOLD_TO)


def find(drafts: DataFrame, id: str, text: str, forms: list[Form] | None = None, matches: bool = False) -> DataFrame:
    """id, kind, start, end, number, scope, part (and match, if asked for) of every citation that is not part of another one.

    Scope is the court, the law, the class or the volume; part the state, or a page.  A form that names the source first
    stands beside the plain form that it holds.  ``matches`` reads the texts once more, as citations are found without marks.
    """
    forms = FORMS if forms is None else forms
    found = spans(drafts, id, without_marks(F.col(text)), {f"{f.kind} {i}": f.pattern for i, f in enumerate(forms)}, 3)
    # The place of a group depends on the form: a table with the group of each field.
    place = lambda field: F.element_at(F.array(*(F.lit(getattr(f, field)) for f in forms)), F.substring_index("kind", " ", -1).cast("int") + 1)
    group = F.array(F.lit(None).cast("string"), F.col("g1"), F.col("g2"), F.col("g3"))
    fields = {name: F.nullif(F.trim(F.get(group, place(name))), F.lit("")) for name in ("number", "scope", "part")}
    found = found.withColumns(fields).withColumn("kind", F.substring_index("kind", " ", 1)).select(id, "kind", "start", "end", *fields)
    # The end of what began before a citation, by the kinds that may hold it: one pass over a document's citations.
    so_far = Window.partitionBy(id).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    inside = F.lit(False)
    for i, (kind, outer) in enumerate(WITHIN.items()):
        found = found.withColumn(f"__{i}", F.max(F.when(F.col("kind").isin(outer), F.col("end"))).over(so_far))
        inside = inside | ((F.col("kind") == kind) & (F.coalesce(f"__{i}", F.lit(0)) > F.col("start")))
    rows = found.where(~inside).drop(*(f"__{i}" for i in range(len(WITHIN))))
    if not matches:
        return rows
    original = drafts.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    return rows.join(original, F.col(id) == F.col("__id")).select(*rows.columns, F.substring("__text", F.col("start"), F.col("end") - F.col("start")).alias("match"))


#: Hits of a citation in the collections that are shown.
MOST_HITS = 3


def key_of(kind: Column, number: Column, scope: Column) -> Column:
    """What a citation and its mention elsewhere have in common: kind, class without steps of appeal, digits."""
    cls = F.when(kind == "PRECEDENT", F.lower(F.regexp_extract(scope, r"(\S+)$", 1))).otherwise("")
    return F.concat_ws(" ", kind, cls, tx.digits(number))


def in_collections(cited: DataFrame, collections: DataFrame, id: str, text: str, most: int = MOST_HITS) -> DataFrame:
    """key, id, rank: the first ``most`` documents, in the order of their ids, that mention a cited precedent or topic.

    Citations of the collections are read once and joined by key; a number with and without dots is one key.
    """
    kinds = ["PRECEDENT", "TOPIC"]
    wanted = cited.where(F.col("kind").isin(kinds)).select(key_of(F.col("kind"), F.col("number"), F.col("scope")).alias("key")).distinct()
    found = find(collections, id, text, [f for f in FORMS if f.kind in kinds])
    mentions = found.select(key_of(F.col("kind"), F.col("number"), F.col("scope")).alias("__key"), F.col(id).alias("__id")).distinct()
    hits = wanted.join(mentions, F.col("key") == F.col("__key")).select("key", F.col("__id").alias(id))
    return at_most(hits, ["key"], [id], most).select("key", id, "rank")


def located(cited: DataFrame, hits: DataFrame, id: str) -> DataFrame:
    """``cited`` (with status) where a citation that its data set lacks, but a collection mentions, is OK; ``seen_in`` says where."""
    per_key = hits.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(F.col(id))).alias("seen_in"))  # a few a key
    rows = cited.join(per_key, key_of(F.col("kind"), F.col("number"), F.col("scope")) == F.col("__key"), "left").drop("__key")
    return rows.withColumn("status", F.when(F.col("status").isin("NO_SOURCE", "NOT_FOUND") & F.col("seen_in").isNotNull(), "OK").otherwise(F.col("status")))
