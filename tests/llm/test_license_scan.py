import random

import numpy as np

from quire.llm import license_scan as ls


def brute(scanner, text):
    """Licences that some window's neighbourhood holds enough of, each window and template compared exactly."""
    h = ls.sequence(text or "")
    out = set()
    for size, members in scanner.classes.items():
        for start in range(0, len(h), size // 2):
            region = set(h[max(0, start - size // 2) : start + 2 * size].tolist())
            for i in members:
                name, s = scanner.sets[i]
                if len(region & set(s.tolist())) >= ls.CONTAINMENT * len(s):
                    out.add(name)
    return out


def test_same_as_comparing_every_window(spark):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(500)]
    texts = [t for own in ls.TEMPLATES.values() for t in own]
    rows = []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        rows.append((i, " ".join(words)))
    rows += [(1, None), (None, ""), (1, "released UNDER the\nMIT license"), (2, "x" * 50_000)]
    got = ls.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    scanner = ls.Scanner(ls.TEMPLATES)
    assert all({m[0] for m in scanner.matches(t or "")} == brute(scanner, t) for _, t in rows)
    assert sorted((str(r.doc_id), [tuple(m) for m in r.matches]) for r in got) == sorted((str(i), scanner.scan(t or "")) for i, t in rows)
    assert sum(bool(r.matches) for r in got) > 100
    assert ls.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_and_bands():
    scanner = ls.Scanner(ls.TEMPLATES)
    assert scanner.scan("a b c Licensed under the Apache License, Version 2.0. d e f") == [("Apache-2.0", 1.0, 3, 11)]
    both = scanner.matches("x This work is licensed under the GNU General Public License, version 3. y")
    assert [m[0] for m in both] == ["GPL-2.0", "GPL-3.0"]
    assert [m[:2] for m in scanner.scan("x This work is licensed under the GNU General Public License, version 3. y")] == [("GPL-3.0", 1.0)]
    assert scanner.scan("nothing of this kind here at all") == []
    least = min(np.ceil(0.75 * len(s)) / (1.5 * c + len(s) - np.ceil(0.75 * len(s))) for c, m in scanner.classes.items() for s in [scanner.sets[i][1] for i in m])
    assert (1 - least) ** scanner.bands <= ls.MISS


def test_each_template_is_its_own_licence():
    """Whole licences, also in capitals, among other words, and with a word in ten altered."""
    scanner = ls.Scanner(ls.TEMPLATES)
    assert len(ls.TEMPLATES) >= 20
    for name, texts in ls.TEMPLATES.items():
        for text in texts:
            words = text.split()
            for version in (text, f"some words before {text.upper()} and some behind"):
                assert {x[0] for x in scanner.scan(version)} == {name}, (name, version)
            if len(words) > 60:
                damaged = " ".join("zzz" if i % 40 == 20 else w for i, w in enumerate(words))
                assert name in {x[0] for x in scanner.scan(damaged)}, name
