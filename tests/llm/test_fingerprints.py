import hashlib

import numpy as np
import xxhash

from broadsheet.llm import fingerprints as fp


def brute(rows):
    """Edited texts, by (doc_id, text); ids are distinct here but for None."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc, text) in enumerate(order):
        text, follower = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc] = text[:len(text) - half] + follower[:half], follower
    return out


def pieces(text):
    """Pieces as tuples of words, each with how many equal ones came before it."""
    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> shift)) * factor % (1 << 64)
        return x

    out, piece, seen = set(), [], {}
    words = (text or "").replace("\n", " \n ").split(" ")
    for i, word in enumerate(words):
        piece.append(word)
        number = 0 if word == "\n" else xxhash.xxh3_64_intdigest(word.encode()) or 1
        if word == "\n" or mixed(number) & 7 == 0 or i == len(words) - 1:
            if piece not in (["\n"], [""]):
                nth = seen.get(tuple(piece), 0)
                seen[tuple(piece)] = nth + 1
                out.add((*piece, nth))
            piece = []
    return out


def test_likeness_by_plain_code(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected, texts = brute(rows), dict(rows)
    got = fp.fingerprint_edits(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        own = pieces(texts[r.doc_id])
        for other, near in zip(expected[r.doc_id], (r.near_edited, r.near_next), strict=True):
            other = pieces(other)
            assert abs(near - (len(own & other) / len(own | other) if own | other else 1)) < 1e-12


def test_very_long_texts(make):
    long = " ".join(f"w{i}" for i in range(150_000))
    got = {r.doc_id: r for r in fp.fingerprint_edits(make((2, long), (1, long + " more"))).collect()}
    assert got[1].n_chars == got[2].n_chars + 5 and got[2].near_next > 0.99 and got[1].fingerprint != got[2].fingerprint


def test_edits_of_the_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = brute(rows)
    got = {r.doc_id: r for r in fp.fingerprint_edits(documents).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    for doc, r in got.items():
        assert r.n_chars == len(texts[doc])
        assert r.edited_sha256 == hashlib.sha256(expected[doc][0].encode()).hexdigest()
    known = fp.WordHashes()
    for doc in list(got)[:40]:
        sets = [set(fp.digests([t], known)[1].tolist()) for t in (texts[doc], *expected[doc])]
        for other, near in ((sets[1], got[doc].near_edited), (sets[2], got[doc].near_next)):
            union = len(sets[0] | other)
            assert abs(near - (len(sets[0] & other) / union if union else 1)) < 1e-12
    by_text = {}
    for doc, r in got.items():
        assert by_text.setdefault(texts[doc], r.fingerprint) == r.fingerprint
    long = [r for r in got.values() if r.n_chars > 500]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_edge_rows(make):
    rows = [(None, "ab cd"), (3, None), (2, ""), (9, "été\n" * 500), (5, "x")]
    got = {r.doc_id: r for r in fp.fingerprint_edits(make(*rows)).collect()}
    expected = brute(rows)
    for doc, text in rows:
        assert got[doc].n_chars == len(text or "")
        assert got[doc].edited_sha256 == hashlib.sha256(expected[doc][0].encode()).hexdigest()
    assert got[3].near_edited == 1 and got[3].fingerprint == got[2].fingerprint


def test_single_repeated_and_none(make):
    one = fp.fingerprint_edits(make((1, "abcd"))).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1
    twice = fp.fingerprint_edits(make((1, "abcd"), (1, "abcd"), (1, "zz"))).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 2
    assert fp.fingerprint_edits(make()).count() == 0


def test_peeling_recovers_the_difference_or_says_so():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 700):
        shared = rng.integers(1, 2**63, 300).astype(np.uint64)
        own = rng.integers(1, 2**63, n).astype(np.uint64)
        zero = np.zeros(300 + n, np.int64)
        for cells in (12, 48, 192, 768, 3072):
            a = fp.Tables(1, cells).add(zero, np.concatenate([shared, own]))
            b = fp.Tables(1, cells).add(zero[:300], shared)
            _, keys, sign, empty = fp.peel(a.minus(b), 1)
            if empty[0]:
                assert set(keys.tolist()) == set(own.tolist()) and (sign == 1).all()
                break
        assert empty[0] and cells <= max(48, 8 * n)
