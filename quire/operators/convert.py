"""From markup and office formats to text, with what was lost measured.

Scanned pages, sound and PDF bytes need models and libraries that are not part of this engine: :func:`page_status` and
:func:`detect_profile` take what such a reader reports and go on from there.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx

BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "header", "footer", "nav", "pre", "hr", "title"}
SILENT = {"script", "style", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.cells = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.out.append("\n")
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.out.append("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("- ")
            elif tag == "tr":
                self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def markdown(html: str) -> str:
    """Headings, list marks and table rows stay, scripts go; white space within a line is one space."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = (re.sub(r"[ \t\u00a0]+", " ", line).strip() for line in "".join(reader.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else markdown(h))


def unfold_lines(text: str) -> str:
    """Joins lines that were only wrapped: a line goes on unless it ends a sentence, or the next opens a block of its own."""
    out: list[str] = []
    fresh = True
    for line in text.split("\n"):
        s = line.strip()
        opens = not s or bool(re.match(r"(#|[-*•|>]|\d+[.)]\s|[a-z]\)\s|Art\.|§|```)", s))
        if fresh or opens or not out or not out[-1] or re.search(r"[.:;!?”\"]$", out[-1]) or out[-1].startswith("#"):
            out.append(s)
        else:
            out[-1] = out[-1][:-1] + s if re.search(r"\w-$", out[-1]) and s[:1].islower() else f"{out[-1]} {s}"
        fresh = not s
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def unfold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unfold_lines(t))


# Groups of an RTF file that hold no text.
RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "datastore", "latentstyles", "listtable", "listoverridetable", "xmlnstbl"}
RTF_TEXT = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_text(data: bytes) -> str:
    """The text of an RTF file: control words, bytes of its code page, unicode characters with their fallbacks skipped, binary
    runs skipped by length, groups without text left out."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    silent, skip_after, skip, i, n = False, 1, 0, 0, len(data)
    word = re.compile(rb"\\([A-Za-z]+)(-?\d+)? ?")

    def put(s: str) -> None:
        if not silent:
            out.append(s)

    while i < n:
        c = data[i : i + 1]
        if c == b"{":
            stack.append((silent, skip_after))
            if data[i + 1 : i + 3] == b"\\*":
                silent = True
            i += 1
            skip = 0
        elif c == b"}":
            silent, skip_after = stack.pop() if stack else (False, 1)
            i += 1
            skip = 0
        elif c == b"\\":
            if m := word.match(data, i):
                name, number = m[1].decode(), int(m[2]) if m[2] else None
                i = m.end()
                if name == "bin":
                    i += max(0, number or 0)
                elif name == "uc":
                    skip_after = number or 0
                elif name == "u" and number is not None:
                    put(chr(number % 65536) if not 0xD800 <= number % 65536 < 0xE000 else "\ufffd")
                    skip = skip_after
                elif name in RTF_SILENT:
                    silent = True
                elif name in RTF_TEXT:
                    put(RTF_TEXT[name])
            elif data[i + 1 : i + 2] == b"'":
                try:
                    char = bytes([int(data[i + 2 : i + 4], 16)]).decode("cp1252", "replace")
                except ValueError:
                    char = ""
                i += 4
                if skip:
                    skip -= 1
                else:
                    put(char)
            else:
                put({b"~": "\u00a0", b"_": "-", b"-": ""}.get(data[i + 1 : i + 2], data[i + 1 : i + 2].decode("latin-1")) if data[i + 1 : i + 2] not in (b"*", b"\n", b"\r") else "")
                i += 2
        elif c in (b"\r", b"\n"):
            i += 1
        else:
            if skip:
                skip -= 1
            else:
                put(c.decode("cp1252", "replace"))
            i += 1
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


@F.pandas_udf(T.StringType())
def rtf_to_text(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else rtf_text(bytes(d)))


def office_text(data: bytes) -> str | None:
    """Paragraphs of a word-processing or e-book file; null if it is no readable archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if "word/document.xml" in names:
                root = ElementTree.fromstring(z.read("word/document.xml"))
                paragraphs = ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p"))
                return "\n".join(p for p in paragraphs if p.strip())
            if "content.xml" in names:
                root = ElementTree.fromstring(z.read("content.xml"))
                return "\n".join(s for p in root.iter() if p.tag.endswith(("}p", "}h")) and (s := "".join(p.itertext()).strip()))
            pages = [x for x in sorted(names) if x.endswith((".xhtml", ".html", ".htm"))]
            return "\n\n".join(markdown(z.read(x).decode("utf-8", "replace")) for x in pages) if pages else None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, OSError):
        return None


@F.pandas_udf(T.StringType())
def office_to_text(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else office_text(bytes(d)))


def decode_bytes(data: bytes) -> str:
    """By mark of order, else UTF-8, else Windows-1252, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


@F.pandas_udf(T.StringType())
def decode(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else decode_bytes(bytes(d)))


#: A page is empty under so many characters, its stamp is all it has under so many useful ones, and it is unread if an
#: image covers so much of it besides.
EMPTY_CHARS, USEFUL_CHARS, IMAGE_COVER = 20, 60, 0.5


def page_status(text: Column, useful: Column, image_cover: Column) -> Column:
    return F.when(F.length(useful) >= USEFUL_CHARS, "read").when(image_cover >= IMAGE_COVER, "unread").when(F.length(text) < EMPTY_CHARS, "empty").otherwise("stamp only")


def image_cover(images: DataFrame, keys: list[str], area: str, page_area: str) -> DataFrame:
    return images.groupBy(*keys).agg(F.least(F.try_divide(F.sum(area), F.max(page_area)), F.lit(1.0)).alias("image_cover"))


def detect_profile(sampled: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """The first rule whose flag holds on some sampled page; rules are (name, flag), the last one the default."""
    flags = sampled.groupBy(*keys).agg(*(F.max(flag.cast("int")).alias(name) for name, flag in rules))
    return flags.select(*keys, F.coalesce(*(F.when(F.col(name) == 1, F.lit(name)) for name, _ in rules), F.lit("generic")).alias("profile"))


def furniture(images: DataFrame, doc: str, page: str, hash: str, pages: DataFrame) -> DataFrame:
    """doc, hash of figures that recur on many pages: at least ``min(3, max(2, pages / 2))``.  ``pages`` has doc, n_pages."""
    seen = images.groupBy(doc, hash).agg(F.countDistinct(page).alias("on_pages"))
    limit = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col("n_pages") / 2)))
    return seen.join(pages, doc).where(F.col("on_pages") >= limit).select(doc, hash, "on_pages")


def first_images(images: DataFrame, doc: str, content: str, order: list[str]) -> DataFrame:
    """One row for each content within a document: the first, with the content's md5."""
    from quire.operators.relational import first_wins

    return first_wins(images.withColumn("md5", F.md5(content)), [doc, "md5"], order)


def otsu(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The grey level that best parts a page's 256-bin histogram (bin, n): the largest variance between both sides."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("bin")
    all_ = Window.partitionBy(*keys)
    h = histogram.withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("bin")).over(w), "N": F.sum("n").over(all_), "S": F.sum(F.col("n") * F.col("bin")).over(all_)})
    w1 = F.col("N") - F.col("w0")
    between = F.col("w0") * w1 * F.pow(F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("S") - F.col("s0"), w1), F.lit(2))
    return h.withColumn("between", F.coalesce(between, F.lit(0.0))).groupBy(*keys).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold"))


def bins(parts: DataFrame, keys: list[str], order: str, size: str, capacity: float, slack: float = 0.97) -> DataFrame:
    """Numbers (from 1) the bins that parts are packed into greedily in order; a part that is too large has one to itself."""
    limit = capacity * slack
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("__p"))
    zero = F.named_struct(F.lit("bin"), F.lit(0), F.lit("held"), F.lit(0.0), F.lit("out"), F.array().cast("array<int>"))

    def step(acc: Column, p: Column) -> Column:
        opens = (acc["bin"] == 0) | (acc["held"] + p[size] > limit)
        bin_ = acc["bin"] + opens.cast("int")
        return F.named_struct(F.lit("bin"), bin_, F.lit("held"), F.when(opens, p[size].cast("double")).otherwise(acc["held"] + p[size]), F.lit("out"), F.concat(acc["out"], F.array(bin_)))

    packed = rows.select(*keys, "__p", F.aggregate("__p", zero, step)["out"].alias("__b"))
    return packed.select(*keys, F.explode(F.arrays_zip("__p", "__b")).alias("x")).select(*keys, F.col(f"x.__p.{order}").alias(order), F.col(f"x.__p.{size}").alias(size), F.col("x.__b").alias("bin"))


def token_kinds(tokens: DataFrame, keys: list[str], order: str, token: str) -> DataFrame:
    """Kind of identifier of each recognised token, a digit more or less allowed; a phone may be two tokens."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    n, follow = F.length(tx.digits(F.col(token))), F.length(tx.digits(F.lead(token).over(w)))
    shape = F.regexp_replace(token, "[0-9]", "9")
    kind = F.when(shape.rlike(r"^9{2,4}\.9{2,4}\.9{2,4}-9{1,3}$") & n.between(10, 12), "CPF").when(shape.rlike(r"^9{1,3}\.9{2,4}\.9{2,4}/9{3,5}-9{1,3}$") & n.between(13, 15), "CNPJ")
    kind = kind.when(F.col(token).rlike(r"^[\w.+-]+@[\w-]+\.[\w.-]+$"), "EMAIL").when(shape.rlike(r"^9{5}-9{3}$"), "POSTCODE").when(shape.rlike(r"^9{4,5}-9{4}$"), "PHONE")
    kind = kind.when(shape.rlike(r"^\(?9{2}\)?$") & F.lead(token).over(w).rlike(r"^[0-9]{4,5}-?[0-9]{4}$") & (follow >= 8), "PHONE")
    return tokens.withColumn("kind", kind)


def phrase_matches(tokens: DataFrame, keys: list[str], order: str, token: str, phrase: list[str]) -> DataFrame:
    """keys, order of the tokens at which a phrase begins, marks and case ignored: an equality of neighbours, no self-join."""
    from pyspark.sql import Window

    from quire.operators.search import fold

    w = Window.partitionBy(*keys).orderBy(order)
    folded = F.regexp_replace(tx.fold_same_length(F.col(token)), tx.NOT_ALNUM, "")
    hit = F.lit(True)
    rows = tokens.withColumn("__t", folded)
    for i, word in enumerate(phrase):
        rows = rows.withColumn(f"__{i}", F.lead("__t", i).over(w))
        hit = hit & (F.col(f"__{i}") == fold(word))
    return rows.where(hit).select(*keys, order)
