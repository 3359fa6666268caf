import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from broadsheet.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i:i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1:
                gone[i] += 1
                gone[min(len(d), i + length)] -= 1
        gone = np.cumsum(gone)[:len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def ours(docs, **kw):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in sd.remove_repeats(docs, **kw).collect())


def expected(rows, length):
    return sorted((str(d), *r) for (d, _), r in zip(rows, brute([t for _, t in rows], length), strict=True))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_all_strings(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ours(docs)
    assert got == expected(rows, 200)
    assert sum(r[2] for r in got) > 1000


def corpus(seed):
    """Passages in many texts, at and inside the bound, periodic and multi-byte texts, copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéü ") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (3, 6, 8, 9, 10, 14, 30)] + ["a" * 90, "ab" * 60]
    rows = []
    for i in range(120):
        parts = [rng.choice([text(rng.randint(0, 12)), rng.choice(passages), rng.choice(passages)[:-1],
                             rng.choice(passages)[1:]]) for _ in range(rng.randint(0, 5))]
        rows.append((i if i % 31 else None, "".join(parts)))
    return [*rows, (5, rows[8][1]), (6, rows[6][1]), (6, rows[6][1]), (200, None), (201, ""), (202, "x" * 700)]


@pytest.mark.parametrize("seed, large", [(1, 1024), (2, 2), (3, 0)])
def test_sorting_and_counting(make, seed, large):
    rows = corpus(seed)
    assert ours(make(*rows), length=40, gram=12, large=large) == expected(rows, 40)


def test_empty_table(make):
    assert ours(make()) == []


def test_suffix_order_is_that_of_the_bytes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 333):
        strings = [bytes(rng.integers(97, 99, rng.integers(0, 30))) for _ in range(n)]
        classes = np.sort(rng.integers(0, 3, n))
        order, common = sd.Suffixes(classes, strings).blocks()
        plain = sorted(range(n), key=lambda i: (classes[i], [*strings[i], 256], i))
        assert order.tolist() == plain
        for k in range(1, n):
            x, y = order[k - 1], order[k]
            same = next((m for m, (a, b) in enumerate(zip(strings[x], strings[y])) if a != b),
                        min(len(strings[x]), len(strings[y])))
            assert common[k] == (same if classes[x] == classes[y] else -1)


def test_collisions_are_noticed(monkeypatch):
    monkeypatch.setattr(sd, "_BYTE", np.ones(257, np.uint64))  # hashes tell lengths apart only
    classes, strings = np.zeros(3, int), [b"abc", b"abd", b"xyz"]
    with pytest.raises(sd.HashCollision):
        sd.Suffixes(classes, strings).blocks()
    assert sd._blocks(classes, strings)[1].tolist() == [-1, 2, 0]


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    data = bytes(np.random.default_rng(0).integers(97, 101, 5000, dtype=np.uint8))
    whole = sd.anchors(data, 200, 64)
    monkeypatch.setattr(sd, "STRETCH", 700)
    parts = sd.anchors(data, 200, 64)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
