import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def samples(spark, sf_dir):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCÉéßœÅ0123456789 '\n\t.,;!?-_\x1c\x85 　ΣσςİıŁ½²中文字🙂éﬁ"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(2000)]
    texts += ["a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "", "   ", "it's we'll 'd THEY'RE", "x" * 30_000, "aaa" * 77, "!!!???" * 50, None]
    return texts


def test_same_as_the_library(spark, sf_dir, library):
    own = bpe.load(bpe.tokenizer_path())
    texts = samples(spark, sf_dir)
    got = own.encode(texts)
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for t, g, w in zip(texts, got, want):
        assert np.frombuffer(g, "<u4").tolist() == w.ids, t
        assert own.decode(g) == library.decode(w.ids, skip_special_tokens=False)
    assert own.merged_exactly > 0


def test_every_code_point_as_the_library_reads_it(library):
    own = bpe.load(bpe.tokenizer_path())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    odd = []
    for at in range(0, len(points), 100_000):
        texts = [f"a{chr(c)}b" for c in points[at : at + 100_000]]
        odd += [t for t, g, w in zip(texts, own.encode(texts), library.encode_batch_fast(texts, add_special_tokens=False)) if np.frombuffer(g, "<u4").tolist() != w.ids]
    assert odd == []


def test_other_tokenizers_are_refused():
    import json

    spec = json.load(open(bpe.tokenizer_path()))
    for part, value in (("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel"}), ("decoder", {"type": "ByteLevel"})):
        with pytest.raises(ValueError, match=part):
            bpe.refuse_others(spec | {part: value})
    for part in ("unk_token", "ignore_merges", "byte_fallback", "end_of_word_suffix"):
        with pytest.raises(ValueError, match=part):
            bpe.refuse_others(spec | {"model": spec["model"] | {part: "x"}})
    with pytest.raises(ValueError, match="added token"):
        bpe.refuse_others(spec | {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]})
    with pytest.raises(ValueError, match="end_of_word_suffix"):
        bpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_exact_merging_agrees_with_speculation(library):
    own = bpe.Bpe(open(bpe.tokenizer_path(), "rb").read())
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 16))) for _ in range(5000)]
    for w, ids in own._learn(sorted(set(words))).items():
        assert np.frombuffer(ids, "<u4").tolist() == own.exact(w.encode())


def test_query_columns(spark, library):
    rows = [(1, "Hello, world", "x"), (2, None, "y"), (2, "", None), (None, "again again", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(df, bpe.tokenizer_path()).collect()
    assert [r.doc_id for r in got] == [1, 2, 2, None]
    for r, (_, text, _) in zip(got, rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(df.limit(0), bpe.tokenizer_path()).count() == 0
