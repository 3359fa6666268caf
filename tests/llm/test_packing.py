import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import packing
from broadsheet.llm.queries import WORD_BPE


def check(rows, docs, capacity):
    """Every piece is right, and sequences are filled without gaps or overlaps."""
    tokenizer = Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            expected[doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(k[3] * n for k, n in expected.items())


@pytest.mark.parametrize("capacity", [256, 4096])
def test_packs_the_table(documents, capacity):
    rows = packing.pack(documents, WORD_BPE, capacity).collect()
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    sequences, tokens = check(rows, docs, capacity)
    assert sequences <= 1.03 * -(-tokens // capacity) + 1


def test_edge_rows(make):
    docs = [(1, None), (1, ""), (None, "a b"), (2, "x " * 9000), (3, "Ünï cod<|endoftext|>é  \n\t don't"),
            (3, "same"), (3, "same"), (4, "́ a b \x1c é")]
    check(packing.pack(make(*docs), WORD_BPE).collect(), docs, 4096)
    assert packing.pack(make(), WORD_BPE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_all_pieces(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([
        rng.integers(1, 4097, 300), rng.integers(1, 200, 400 * (seed % 2)),
        np.full(500, 1300 + seed), rng.integers(2000, 2100, 200 * (seed % 3)),
    ])
    counts = Counter(lengths.tolist())
    types = packing.plan(counts)
    used = Counter()
    for times, held in types:
        assert times > 0 and sum(held) <= 4096
        for length in held:
            used[length] += times
    assert used == counts
    bins = sum(t for t, _ in types)
    # first fit decreasing, for comparison
    room = []
    for length in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= length), None)
        if at is None:
            room.append(4096 - length)
        else:
            room[at] -= length
    assert bins <= 1.06 * len(room) + 16


def test_marks_that_end_words_are_not_learnt_with_them():
    """Ids are the tokenizer's, and a word followed by a mark takes no place of its own."""
    words, tokenizer = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    texts = ["one, two. three, one. two\nthree.", "a.. b, c", ", a. ", "_, a, b", "1, 2. 3", "é, ß. ſ. ", ""]
    for text in texts:
        (ids,) = words.of_texts([text])
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not {"one,", "two.", "three,", "one."} & set(words.known)
