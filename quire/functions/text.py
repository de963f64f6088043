"""Text functions as Spark columns.  Four normalizers exist side by side and are never mixed: see each one's docstring."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and the letters that stay when the marks go, one for one."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code) and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()
#: The fold as SQL, for a column named by ``{}``.
FOLD_SQL = f"lower(translate({{}}, '{FOLD_FROM}', '{FOLD_TO}'))"


def fold_same_length(text: Column) -> Column:
    """Lower case without marks, letter for letter: offsets in the result are offsets in the original.  For anything that slices."""
    # Texts of one byte a letter have no marks to take off; they are the greater part of most collections.
    plain = F.octet_length(text) == F.length(text)
    return F.lower(F.when(plain, text).otherwise(F.translate(text, FOLD_FROM, FOLD_TO)))


def squash(text: Column) -> Column:
    """Folded, every run of other than ``[a-z0-9]`` one space, trimmed.  For comparing quotations and keys."""
    return F.trim(F.regexp_replace(fold_same_length(text), "[^a-z0-9]+", " "))


def mark_whitespace(text: Column) -> Column:
    """Bold marks become two spaces, so that phrases match across them and offsets stay."""
    return F.regexp_replace(text, r"\*\*", "  ")


@F.pandas_udf(T.StringType())
def fold_ascii(text: pd.Series) -> pd.Series:
    """NFKD, non-ASCII dropped, lower case: changes lengths; only for matching, never for offsets."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())


@F.pandas_udf(T.StringType())
def fold_upper(text: pd.Series) -> pd.Series:
    """As :func:`fold_ascii`, upper case."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().upper())


@F.pandas_udf(T.StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """NFD without non-spacing marks: case, signs and ordinals stay."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """NFC without NUL."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\0", "")))


WORD = r"[\p{L}\p{N}]+"
NOT_ALNUM = r"[^\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold_same_length(text), F.lit(WORD), F.lit(0))


def duplicate_key(text: Column, chars: int = 200) -> Column:
    """The first letters and digits, folded: equal for copies whose margins differ.

    Most texts show them within a few times as many characters; only those that do not are read whole.
    """
    key = lambda t: F.substring(F.regexp_replace(fold_same_length(t), NOT_ALNUM, ""), 1, chars)
    head = key(F.left(text, F.lit(4 * chars)))
    return F.when(F.length(head) >= chars, head).otherwise(key(text))


def content_hash(text: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(digits))


def slug(text: Column, upper: bool = False) -> Column:
    folded = fold_same_length(text)
    out = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.upper(out) if upper else out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, start: Column, length: Column | int, context: int) -> Column:
    """``context`` characters around a hit at ``start`` (from 1), half on each side, clamped and squeezed."""
    first = F.greatest(start - context // 2, F.lit(1))
    last = F.least(start + F.lit(length) + context // 2, F.length(text) + 1)
    return squeeze(F.substring(text, first, last - first))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_ALNUM, ""))


CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def control_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CONTROL))


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def without_lines(text: Column, patterns: list[str]) -> Column:
    """Drops lines that match any pattern from their start; pair with :func:`lines_dropped` for the count."""
    any_ = "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(any_)), "\n")


def lines_dropped(text: Column, patterns: list[str]) -> Column:
    return F.size(F.split(text, "\n", -1)) - F.size(F.split(without_lines(text, patterns), "\n", -1))


def useful_text(text: Column, stamps: list[str]) -> Column:
    """Without stamp lines, white space collapsed."""
    return squeeze(without_lines(text, stamps))


def is_title(line: Column) -> Column:
    """4 to 80 characters, at least four letters, at least 80 % of them upper case."""
    s = F.trim(line)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    return F.length(s).between(4, 80) & (letters >= 4) & (F.regexp_count(s, F.lit(r"\p{Lu}")) * 5 >= letters * 4)


def value_after(text: Column, label: str) -> Column:
    """The first line with text after the line that is the label."""
    lines = F.split(text, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.trim(x)), F.lit(label))
    rest = F.slice(lines, (at + 1).cast("int"), F.greatest(F.size(lines), F.lit(1)))
    return F.when(at > 0, F.get(F.filter(F.transform(rest, lambda x: F.trim(x)), lambda x: x != ""), 0))


def line_number(text: Column, position: Column) -> Column:
    """The line (from 1) that a character position (from 1) lies in."""
    return F.size(F.split(F.substring(text, F.lit(1), position), "\n", -1))


def first_useful_line(text: Column, chars: int = 120) -> Column:
    """The first body line that is no heading, list mark or fence, its marks removed and cut."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(#|---|```|>|\\|)"))
    return F.left(F.trim(F.regexp_replace(F.get(lines, 0), r"^[-*+]\s+|[*_`]|\[\[|\]\]", "")), F.lit(chars))


def strip_tags(html: Column) -> Column:
    """Scripts, styles, comments and tags out, white space squeezed."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return squeeze(F.regexp_replace(text, "<[^>]*>", " "))


# The entities that are decoded, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def paragraphs(text: Column, least: int = 30) -> Column:
    """Bodies of ``<p>`` longer than ``least`` without their tags."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(bodies, lambda b: squeeze(F.regexp_replace(b, "<[^>]*>", " "))), lambda b: F.length(b) > least)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target|label]]``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.split(x, r"[|#]", 2)[0]))


def references(text: Column) -> Column:
    """Paths and addresses in prose, cut at the sign that ends a sentence."""
    found = F.regexp_extract_all(text, F.lit(r"(?:https?://|[A-Za-z]:[\\/]|~/|\./|/)[^\s\"'<>`|)\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?]+$", "")))


def front_matter(text: Column) -> Column:
    """``key: value`` lines between a first and a later line of three dashes, as a map; the word null and quotes are read.

    Without a closing line there is no front matter, and the map is empty.
    """
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n", -1), lambda x: x.rlike(r"^\s*\w+:"))
    key = lambda x: F.regexp_extract(x, r"^\s*(\w+):", 1)
    raw = lambda x: F.trim(F.regexp_extract(x, r"^\s*\w+:\s*(.*)$", 1))
    value = lambda x: F.when(raw(x) == "null", F.lit(None).cast("string")).otherwise(F.regexp_replace(raw(x), r'^"(.*)"$', "$1"))
    # Of repeated keys the last holds.
    return F.map_from_entries(F.transform(F.map_values(F.aggregate(lines, F.create_map().cast("map<string,struct<key:string,value:string>>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != key(x)), F.create_map(key(x), F.struct(key(x).alias("key"), value(x).alias("value")))))), lambda e: e))


def body_after_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\n---", "")


def page_ranges(spec: Column, total: Column) -> Column:
    """``"1-3,7,9-"`` as the pages it names, in order and with repeats; open ends reach the first or the last page."""
    part = lambda p, g: F.regexp_extract(p, r"^\s*(\d*)\s*(-?)\s*(\d*)\s*$", g)

    def pages(p: Column) -> Column:
        a = F.coalesce(part(p, 1).try_cast("int"), F.lit(1))
        b = F.when(part(p, 2) == "", a).otherwise(F.coalesce(part(p, 3).try_cast("int"), total))
        kept = F.when((F.greatest(a, F.lit(1)) <= F.least(b, total)), F.sequence(F.greatest(a, F.lit(1)), F.least(b, total)))
        return F.coalesce(kept, F.array().cast("array<int>"))

    return F.flatten(F.transform(F.filter(F.split(spec, ","), lambda p: F.trim(p) != ""), pages))


def parse_size(text: Column) -> Column:
    """``"10MB"``, ``"1.5 k"`` in bytes; anything else is null."""
    unit = F.upper(F.regexp_extract(text, r"(?i)^\s*[\d.]+\s*([KMG]?)B?\s*$", 1))
    number = F.regexp_extract(text, r"(?i)^\s*(\d+(?:\.\d+)?)\s*[KMG]?B?\s*$", 1).try_cast("double")
    factor = F.when(unit == "K", 2**10).when(unit == "M", 2**20).when(unit == "G", 2**30).otherwise(1)
    return F.floor(number * factor).cast("long")


def format_size(n: Column) -> Column:
    return F.when(n >= 2**20, F.format_string("%.1f MB", n / 2**20)).when(n >= 2**10, F.format_string("%.1f KB", n / 2**10)).otherwise(F.format_string("%d B", n))


def hms(seconds: Column, rounded: bool = True) -> Column:
    """Seconds as hh:mm:ss, rounded or cut."""
    s = (F.round(seconds) if rounded else F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("long")


def sample_list(values: Column, most: int = 6) -> Column:
    """``"a, b (+n)"``: the first values and how many more there are."""
    shown = F.array_join(F.slice(values, 1, most), ", ")
    return F.when(F.size(values) > most, F.concat(shown, F.format_string(" (+%d)", F.size(values) - most))).otherwise(shown)


def months_of(text: Column) -> Column:
    """``3a``, ``2a6m``, ``6m``, ``2 anos e 6 meses`` in months; anything else is null."""
    s = F.regexp_replace(F.lower(text), " ", "")
    shape = r"^(?:(\d+)a(?:nos?)?)?(?:e?(\d+)m(?:es(?:es)?)?)?$"
    years, months = (F.regexp_extract(s, shape, g).try_cast("int") for g in (1, 2))
    return F.when(s.rlike(shape) & (years.isNotNull() | months.isNotNull()), F.coalesce(years, F.lit(0)) * 12 + F.coalesce(months, F.lit(0)))


# Month names and their numbers.
MONTHS = {m: i + 1 for i, m in enumerate(["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"])}
MONTHS |= {m[:3]: i for m, i in list(MONTHS.items())}


def br_date(text: Column) -> Column:
    """dd/mm/yyyy; impossible dates are null."""
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "d/M/yyyy"))


def named_date(text: Column) -> Column:
    """``12 de março de 2024``, ``12 mar 2024``; impossible dates are null."""
    folded = fold_same_length(text)
    shape = r"(\d{1,2})\s*(?:de\s+)?([a-z]{3,9})\.?\s*(?:de\s+)?(\d{4})"
    table = F.create_map(*(x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))))
    month = F.try_element_at(table, F.regexp_extract(folded, shape, 2))
    return F.try_to_date(F.concat_ws("/", F.regexp_extract(folded, shape, 1), month.cast("string"), F.regexp_extract(folded, shape, 3)), "d/M/yyyy")


TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def url_identity(url: Column) -> Column:
    """One key for addresses of one item: scheme, ``www.``/``m.``/``amp.`` hosts, fragments, tracking parameters, a trailing
    slash and a ``-2`` suffix do not tell items apart."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z]+://", "")
    u = F.regexp_replace(u, r"^(?:www|m|amp)\.", "")
    u = F.regexp_replace(u, f"([?&]){TRACKING}=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"([?&])&+", "$1"), r"[?&]+$", "")
    u = F.regexp_replace(u, r"([^/])/+$", "$1")
    return F.regexp_replace(F.lower(u), r"([a-z])-\d{1,2}$", "$1")


def process_key(kind: Column, number: Column) -> Column:
    """Class and number without signs."""
    return F.concat(F.upper(kind), digits(number))


def process_number(text: Column) -> Column:
    """By shape: a dotted number, else one of three and more digits, else the last number."""
    dotted = F.regexp_extract(text, r"\d{1,3}(?:\.\d{3})+", 0)
    plain = F.regexp_extract(text, r"\d{3,}", 0)
    last = F.get(F.reverse(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))), 0)
    return F.when(dotted != "", dotted).when(plain != "", plain).otherwise(last)


def article_key(text: Column) -> Column:
    """An article's number without ordinal sign and dots, its letter suffix upper case."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^art\.?\s*", ""), r"[º°ª.\s]", ""))
    return F.regexp_replace(bare, r"^(\d+)O$", "$1")


def article_sort(key: Column) -> list[Column]:
    """Columns to order articles by: number, then suffix."""
    return [F.regexp_extract(key, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(key, r"^\d+-?([A-Z]*)", 1)]


def query_pattern(query: str) -> str:
    """A pattern in which any white space may stand between the words of the folded query."""
    folded = unicodedata.normalize("NFD", query)
    folded = "".join(c for c in folded if not unicodedata.combining(c)).lower()
    return r"\s*".join(re.escape(w) for w in folded.split())
