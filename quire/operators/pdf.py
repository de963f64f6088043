"""Text layers of PDF files, page by page, without any library: cross-reference tables are not needed, as objects are found by
their own marks.  Pages without a text layer come out empty and are told apart, so that nothing unread passes for read.

Understood: object streams, page trees, plain and deflated content, text operators, ToUnicode maps, Latin text otherwise.
Not understood, and an error: encryption; other filters leave their stream empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.0-9]+|'|\"|[A-Za-z*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A move to the left by so many thousandths of a letter's height between pieces of a line stands for a space.
SPACE = -180


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.objects: dict[int, bytes] = {int(n): body for n, _, body in OBJECT.findall(data)}  # of versions the last holds
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        content = self.stream(body)
        first = int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = [int(x) for x in content[:first].split()]
        ends = [*numbers[3::2], len(content) - first]
        for n, at, end in zip(numbers[::2], numbers[1::2], ends):
            self.objects.setdefault(n, content[first + at : first + end])

    def stream(self, body: bytes) -> bytes:
        """The content of a stream object; nothing if its filter is not understood."""
        found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not found:
            return b""
        head = body[: found.start()]
        names = re.findall(rb"/([A-Za-z0-9]+)", m[1]) if (m := re.search(rb"/Filter\s*(\[[^\]]*\]|/[A-Za-z0-9]+)", head)) else []
        if not names:
            return found[1]
        if names != [b"FlateDecode"]:
            return b""
        try:
            return zlib.decompressobj().decompress(found[1])
        except zlib.error:
            return b""

    def value(self, body: bytes, key: bytes) -> bytes:
        """What stands behind a key of a dictionary: an object, if it is a reference, else the text from there on."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        ref = REFERENCE.match(rest)
        return self.objects.get(int(ref[1]), b"") if ref else rest

    def pages(self) -> Iterator[bytes]:
        """Page objects in the order of the page tree; each carries the resources that it inherits behind its own."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        seen: set[bytes] = set()

        def walk(node: bytes, inherited: bytes) -> Iterator[bytes]:
            if node in seen:
                return
            if kids := re.search(rb"/Kids\s*\[([^\]]*)\]", node):
                seen.add(node)
                own = b" /Resources " + r if (r := self.value(node, b"Resources")) else inherited
                for ref in REFERENCE.findall(kids[1]):
                    yield from walk(self.objects.get(int(ref), b""), own)
            elif re.search(rb"/Type\s*/Page\b", node):
                yield node + inherited

        for root in roots[-1:]:
            yield from walk(self.value(root, b"Pages"), b"")

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """Name of each font of a page that has one: its map from codes to text."""
        fonts = self.value(self.value(page, b"Resources"), b"Font") or self.value(page, b"Font")
        out = {}
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts.split(b">>")[0]):
            body = self.objects.get(int(ref), b"")
            if unicode := self.value(body, b"ToUnicode"):
                out[name] = code_map(self.stream(unicode))
        return out

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        return b"\n".join(self.stream(self.objects.get(int(r), b"")) for r in REFERENCE.findall(m[1])) if m else b""


def code_map(source: bytes) -> dict[bytes, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            base = text(to)
            for i in range(int(b, 16) - int(a, 16) + 1):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = base[:-1] + chr(ord(base[-1]) + i)
    return out


def _bytes(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else ESCAPES.get(m[2], b"" if m[2] in b"\r\n" else m[2])
    return re.sub(rb"\\(?:([0-7]{1,3})|(.))", octal, token[1:-1], flags=re.S)


def _shown(token: bytes, codes: dict[bytes, str] | None) -> str:
    data = _bytes(token)
    if not codes:
        return data.decode("cp1252", "replace")
    width = max(map(len, codes))
    return "".join(codes.get(data[i : i + width], "�") for i in range(0, len(data), width))


def page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """Lines of the text that a page's content shows, in the order in which it is shown."""
    out, line, codes, operands = [], "", None, []
    depth, pieces = 0, ""
    for token in TOKEN.findall(content):
        first = token[:1]
        if first == b"[":
            depth, pieces = 1, ""
        elif first == b"]":
            depth = 0
            operands.append(pieces)
        elif first in b"(<":
            if depth:
                pieces += _shown(token, codes)
            else:
                operands.append(_shown(token, codes))
        elif first in b"-+.0123456789":
            try:
                number = float(token)
            except ValueError:
                continue
            if depth:
                pieces += " " if number <= SPACE and not pieces.endswith(" ") else ""
            else:
                operands.append(number)
        elif first == b"/":
            operands.append(token[1:])
        else:
            numbers = [x for x in operands if isinstance(x, float)]
            texts = [x for x in operands if isinstance(x, str)]
            moved = token in (b"T*", b"'", b'"') or (token in (b"Td", b"TD") and len(numbers) > 1 and numbers[-1] != 0) or token in (b"Tm", b"ET")
            if moved and line:
                out.append(line)
                line = ""
            if token == b"Tf" and operands and isinstance(operands[0], bytes):
                codes = fonts.get(operands[0])
            elif token in (b"Tj", b"TJ", b"'", b'"') and texts:
                line += texts[-1]
            elif token in (b"Td", b"TD") and numbers and line and not line.endswith(" "):
                line += " "
            operands = []
    return "\n".join(x.strip() for x in [*out, line] if x.strip())


def read_pages(data: bytes | None) -> tuple[list[str], str | None]:
    """The text of each page, and what went wrong, if anything did."""
    try:
        if data is None:
            raise ValueError("no file")
        pdf = Pdf(data)
        return [page_text(pdf.content(p), pdf.fonts(p)) for p in pdf.pages()], None
    except (ValueError, TypeError, KeyError, IndexError) as e:
        return [], str(e) or type(e).__name__


def pages(files: DataFrame, id: str, content: str) -> DataFrame:
    """id, page, text, empty (no text layer), error: a row for each page, or one row with the error for a file without any."""

    @F.pandas_udf("struct<pages:array<string>,error:string>")
    def read(data: pd.Series) -> pd.DataFrame:
        found = [read_pages(None if d is None else bytes(d)) for d in data]
        return pd.DataFrame({"pages": [p for p, _ in found], "error": [e or (None if p else "no pages") for p, e in found]})

    rows = files.select(id, read(content).alias("r")).select(id, "r.error", F.posexplode_outer("r.pages").alias("n", "text"))
    return rows.select(id, (F.col("n") + 1).alias("page"), "text", (F.length("text") == 0).alias("empty"), "error")
