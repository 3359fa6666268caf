import random
import re

import numpy as np
import pytest

from broadsheet.llm import ngram_join as nj
from broadsheet.llm.components import components


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """{(doc_id, text): (n, component)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return sorted(((str(d), len(s), str(smallest.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))))


def ours(docs, **kw):
    found = nj.near_duplicates(docs, **kw).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    assert ours(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def corpus(seed, frequent):
    """Copies with edits, chains of them, passages in many documents, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 60]))] for _ in range(4)]
    rows, base = [], []
    for i in range(260):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base[-12:] if rng.random() < 0.7 else base[:2]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if words:
                    at = rng.randrange(len(words))
                    words[at:at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 12, 40, 150]))]
        if rng.random() < frequent:
            words = words + rng.choice(passages)
        base.append(words)
        rows.append((i if i % 50 else None, rng.choice([" ", "\n", "  "]).join(words).title()))
    return [*rows, (7, rows[9][1]), (8, rows[8][1]), (8, rows[8][1]), (9, None), (9, "")]


@pytest.mark.parametrize("seed, frequent, limit", [(2, 0.5, 2), (3, 0.9, 4), (4, 0.3, 1)])
def test_lengthened_prefixes(make, seed, frequent, limit):
    rows = corpus(seed, frequent)
    assert ours(make(*rows), frequent=limit) == brute(rows)


def test_dense_group_with_and_without_links(make):
    """Near copies of one text whose pairs lie on both sides of the threshold."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(240)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in rng.sample(range(240), rng.choice([1, 3, 5, 7, 9, 11, 14])):
            words[k] = f"x{rng.randrange(10**9)}" if rng.random() < .7 else rng.choice(base)
        rows.append((i, " ".join(words)))
    assert ours(make(*rows), frequent=8) == brute(rows)


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    rng = np.random.default_rng(5)
    one = rng.integers(-2**63, 2**63 - 1, 300)
    other = np.concatenate([one[:260], rng.integers(-2**63, 2**63 - 1, 50)])
    rows = [(1, np.sort(one).tolist()), (2, np.sort(other).tolist())]
    marked = nj._sketches(spark.createDataFrame(rows, "sid long, tokens array<long>")).collect()
    a, b = (r.sketch for r in sorted(marked))
    assert 0 < sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + 2**64).bit_count()
                   for x, y in zip(a, b, strict=True)) <= 90


def test_choice_keeps_every_similar_pair():
    """For random pairs at the threshold, the chosen prefixes share what both demand at least."""
    rng = np.random.default_rng(0)
    tried = 0
    for _ in range(4000):
        n = int(rng.integers(1, 200))
        x = rng.choice(1 << 40, n, replace=False)
        drop = int(rng.integers(0, n // 4 + 1))
        y = np.concatenate([x[drop:], rng.choice(1 << 40, int(rng.integers(0, n // 5 + 1))) + (1 << 41)])
        if 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
            continue
        frequent = np.concatenate([x, y])[rng.random(len(x) + len(y)) < rng.choice([0, 0.05, 0.15, 0.5])]
        held, demand, dense = [], [], []
        for s in (np.sort(x), np.sort(y)):
            kept = s[:nj.looked_at(len(s), 75)]
            df = np.where(np.isin(kept, frequent), nj.FREQUENT + 1, rng.integers(2, 9, len(kept)))
            chosen = nj._choose(len(s), np.arange(len(kept)), df, 75)
            length, need = chosen or (len(s), nj.DENSE)
            held.append(kept[:length][~np.isin(kept[:length], frequent)])
            demand.append(need)
            dense.append(chosen is None)
        if all(dense):
            continue
        tried += 1
        assert len(np.intersect1d(*held)) >= min(demand)
    assert tried > 1000


def test_empty_table_and_one_row(make):
    assert ours(make()) == []
    assert ours(make((3, "a b"))) == [("3", 1, "3")]


def test_keeps_one_of_each_group(make):
    text = " ".join(f"word{i}" for i in range(40))
    docs = make((5, text), (3, text + " more"), (3, text + " more"), (8, "other text"), (9, None), (10, ""),
                (None, text))
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "3", "8", "9"]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1002, 1000), (1000, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, **{i: 1000 for i in (1000, 1001, 1002)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_each_different_word_is_hashed_once(monkeypatch):
    """Over all texts of a slice; words are those of a plain split."""
    hashed = []
    digest = nj.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(nj.xxhash, "xxh3_64_intdigest", lambda w: hashed.append(w) or digest(w))
    texts = [b" A b  a B a b\t", b"", b"\x0b\x0c\r\n", b"a b a b a b", "É é\u00a0x\u2003y a b c".encode()]
    sets = [s.tolist() for s in nj.shingle_sets(texts, 5)]
    plain = [w for t in texts for w in t.lower().split()]
    assert sorted(hashed) == sorted(set(plain))
    assert nj.word_hashes(texts)[0].tolist() == [len(t.split()) for t in texts]
    assert sets[0] == sets[3] and len(sets[0]) == 2 and sets[1] == sets[2] == [] and len(sets[4]) == 1
