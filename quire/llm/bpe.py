"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of a word.  One vectorised test per batch says for every adjacent pair of proposed
tokens whether merging could have crossed their border; a word whose pairs all pass is encoded, as each token is what its own
string merges to and no border is crossed.  Only words with a failing pair are merged exactly, in order of rank.

The border test.  The pieces of a left token that touch the border are its right spine (the token, its right part, that
one's right part ..); those of a right token are its left spine.  A piece lives from the merge that makes it to the merge
that uses it, and ranks grow from part to whole, so a merge of piece x with piece y of rank m happens across the border
just if ``m < death(x)`` and ``m <= death(y)``: at equal ranks the leftmost merge comes first.  Tokens that break the order of
ranks, or whose own string merges to something else, are never proposed.

Defined results
  * null and empty texts give no ids and an empty decoded text;
  * strings of the special tokens inside a text become the special ids, as in the library's default;
  * rows with a null or a repeated ``doc_id`` are encoded like any other, row by row; an empty table gives an empty result;
  * texts are read whole at any length; further columns are passed through untouched.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import hold, read, small_batches

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker keeps encoded, in each of two generations.
CACHE_WORDS = 200_000
#: Bytes of text that are encoded at once.
GROUP_CHARS = 1_000_000
END = "</w>"
#: Symbols of a word up to which it is merged without a heap.
FEW = 48
NEVER = np.int64(1) << 40

# The contractions, and white space as the tokenizer's own patterns take it.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# The tokenizers library reads letters and numbers as of Unicode 16.0.  What the pattern package takes for such and
# 16.0 does not know, and the lower case, which it reads as of 17.0, of letters that came after 15.1.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
FIRST_NEWER = chr(min(NEWER)[0])

#: The parts of a tokenizer file that this module does, as the file states them; a file that states others is refused.
SUPPORTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": CONTRACTIONS + "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
SUPPORTED_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def refuse_others(spec: dict) -> None:
    """An error for a tokenizer file whose parts this module does not do, rather than other ids than the library's."""
    stated = {name: spec.get(name) for name in SUPPORTED} | {name: spec["model"].get(name, default) for name, default in SUPPORTED_MODEL.items()}
    odd = sorted(name for name, value in (SUPPORTED | SUPPORTED_MODEL).items() if stated[name] != value)
    odd += sorted({f"added token {t['content']}" for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"]})
    if odd:
        raise ValueError(f"tokenizer parts that are not supported: {', '.join(odd)}")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    """The tables of one tokenizer file, and the words that this worker has seen."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        refuse_others(spec)
        vocab = dict(spec["model"]["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        n = len(self.strings)
        self.left, self.right, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.merge:
                self.merge[x, y] = (r, z)
                if self.rank[z] < 0:
                    self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * n + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self._spines(n)
        sound = self._sound(n)
        alphabet = byte_alphabet()
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + END] for c in alphabet]
        bytes_of = {c: b for b, c in enumerate(alphabet)}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            if sound[i]:
                table, chars = (self.final, token[: -len(END)]) if token.endswith(END) and token != END else (self.inner, token)
                table[bytes(bytes_of[c] for c in chars)] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.width = n
        self.ascii = re.compile(f"{CONTRACTIONS}|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")
        self.any = regex.compile(f"{CONTRACTIONS}|\\p{{L}}+|\\p{{N}}|[^{WHITE}\\p{{L}}\\p{{N}}]+")
        newer = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
        self.newer = re.compile(f"[{newer}]")
        self.rare = regex.compile(f"(?V1){CONTRACTIONS}|[\\p{{L}}--[{newer}]]+|[\\p{{N}}--[{newer}]]|(?:[^{WHITE}\\p{{L}}\\p{{N}}]|[{newer}])+")
        self.later_case = re.compile("[" + "".join(map(chr, LOWER)) + "]")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merged_exactly = 0

    def _spines(self, n: int) -> None:
        """For each token the pieces at its right and at its left end, and the rank at which each is used up."""
        for side, part in (("right_spine", self.right), ("left_spine", self.left)):
            pieces, deaths, now, death = [], [], np.arange(n), np.full(n, NEVER)
            while (now >= 0).any():
                pieces.append(now)
                deaths.append(death)
                death = np.where(now >= 0, self.rank[now], 0)
                now = np.where(now >= 0, part[now], -1)
            setattr(self, side, (np.stack(pieces, 1), np.stack(deaths, 1)))

    def _crossed(self, a: np.ndarray, b: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
        """Whether merging crosses the border of each pair; with ``whole``, before the merge of that rank, made of the pair itself."""
        (xs, xd), (ys, yd) = self.right_spine, self.left_spine
        out = np.zeros(len(a), bool)
        depth_a, depth_b = (xs[a] >= 0).sum(1), (ys[b] >= 0).sum(1)
        for i in range(int(depth_a.max(initial=0))):
            rows = np.flatnonzero(depth_a > i)
            for j in range(int(depth_b[rows].max(initial=0))):
                at = rows[(depth_b[rows] > j) & ~out[rows]]
                if whole is not None and i == j == 0:
                    continue
                key = xs[a[at], i] * np.int64(len(self.strings)) + ys[b[at], j]
                pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                m = np.where(self.keys[pos] == key, self.ranks[pos], NEVER)
                dx, dy = xd[a[at], i], yd[b[at], j]
                if whole is not None:
                    dx, dy = np.minimum(dx, whole[at]), np.minimum(dy, whole[at])
                out[at] |= (m < dx) & (m <= dy) & (m < NEVER)
        return out

    def _sound(self, n: int) -> np.ndarray:
        """Tokens that their own string merges to, through parts of lower ranks."""
        made = np.flatnonzero(self.rank >= 0)
        l, r = self.left[made], self.right[made]
        ok = np.ones(n, bool)
        ok[made] = (self.rank[l] < self.rank[made]) & (self.rank[r] < self.rank[made]) & ~self._crossed(l, r, self.rank[made])
        for z in made[np.argsort(self.rank[made])]:
            ok[z] &= ok[self.left[z]] & ok[self.right[z]]
        return ok

    def _greedy(self, word: bytes) -> list[int] | None:
        out, at, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while at < n:
            rest = n - at
            if rest <= longest and (token := final.get(word[at:])) is not None:
                out.append(token)
                return out
            for size in range(min(longest, rest - 1), 0, -1):
                if (token := inner.get(word[at : at + size])) is not None:
                    break
            else:
                return None
            out.append(token)
            at += size
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges in order of rank, at equal ranks from the left."""
        self.merged_exactly += 1
        ids: list[int] = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._merge_few(ids) if len(ids) <= FEW else self._merge_many(ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        """Looks for the lowest rank again after each merge: quicker than a heap while there are few symbols."""
        get, none = self.merge.get, (1 << 40, -1)
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found and (least := min(found))[1] >= 0:
            i = found.index(least)
            ids[i : i + 2] = [least[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heap = [(r, i, z) for r, z, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.merge.get((ids[i], ids[j])) != (r, z):
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words not yet seen."""
        coded = [w.encode() for w in new]
        proposed = [self._greedy(w) for w in coded]
        sizes = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.fromiter((x for p in proposed if p for x in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(new)), sizes)
        inside = owner[1:] == owner[:-1]
        keys, of = (flat[:-1] * self.width + flat[1:])[inside], owner[1:][inside]
        unique, back = np.unique(keys, return_inverse=True)
        pos = np.minimum(np.searchsorted(self.pairs, unique), max(len(self.pairs) - 1, 0))
        known = self.pairs[pos] == unique if len(self.pairs) else np.zeros(len(unique), bool)
        fits = np.zeros(len(unique), bool)
        fits[known] = self.fits[pos[known]]
        fresh = unique[~known]
        fits[~known] = ~self._crossed(fresh // self.width, fresh % self.width)
        if len(self.pairs) > 4 * CACHE_WORDS:
            self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        pairs = np.concatenate([self.pairs, fresh])
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits[~known]])[order]
        failing = set(of[~fits[back]].tolist())
        out = {}
        for i, w in enumerate(new):
            ids = self.exact(coded[i]) if proposed[i] is None or i in failing else proposed[i]
            out[w] = np.array(ids, "<u4").tobytes()
        return out

    def split(self, text: str) -> list[str | int]:
        """The words of a text; a special token is its id."""
        out: list[str | int] = []
        for part in self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out += self.ascii.findall(part.lower())
            else:
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ").lower()  # no final sigma: letter by letter
                if max(part) >= FIRST_NEWER:
                    part = part.translate(LOWER) if self.later_case.search(part) else part
                    out += (self.rare if self.newer.search(part) else self.any).findall(part)
                else:
                    out += self.any.findall(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, four bytes each, least byte first."""
        words = [self.split(t or "") for t in texts]
        unique: set = set()
        for w in words:
            unique.update(w)
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        new = []
        for w in unique:
            if w not in self.words:
                if (seen := self.older.get(w)) is not None:
                    self.words[w] = seen
                elif isinstance(w, int):
                    self.words[w] = w.to_bytes(4, "little")
                else:
                    new.append(w)
        if new:
            self.words.update(self._learn(new))
        of = self.words.__getitem__
        return [b"".join(map(of, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with spaces between, as the library does where a tokenizer names no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Bpe(f.read())
    return _LOADED[path]


def groups(texts: pa.Array, size: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` without ``text`` but with ``ids`` (binary, four bytes a token) and, if asked for, the text decoded from these.

    ``path`` is the tokenizer's file, there on every machine as part of an installed package.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", _LOADED.clear)
        bpe = load(path)
        for batch in batches:
            texts = batch.column(len(rest))
            for a, b in groups(texts):
                out = bpe.encode(texts.slice(a, b - a).to_pylist())
                columns = [batch.column(i).slice(a, b - a) for i in range(len(rest))] + [pa.array(out, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, ids, *[decoded] * bool(decoded)])

    fields = [docs.schema[c] for c in rest] + [T.StructField(ids, T.BinaryType())]
    fields += [T.StructField(decoded, T.StringType())] * bool(decoded)
    return docs.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, derived from the ids and the decoded text."""
    rows = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), tokenizer_path())
