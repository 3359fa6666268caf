import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from broadsheet.llm import transducer as tr
from broadsheet.llm.queries import PIECE_BPE


@pytest.fixture(scope="module")
def official():
    return SentencePieceProcessor(model_file=PIECE_BPE)


@pytest.fixture(scope="module")
def ours():
    return tr.Transducer(PIECE_BPE)


def ids(ours, text):
    return np.frombuffer(ours.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", [
    "", " ", "   ", "a", " a  b ", "\n\tx ", "\n", "\n\n a\n", "▁x", "ﬁ① 日本語テキスト 😀😀", "é é",
    "\x00\x01", "<s> </s> <unk> <0x41>", "x" * 300, " " * 100 + "y", "don't stop-it; 3.14159", "ＡＢＣ",
    "a" + " " * 33 + "b" + " " * 7,
])
def test_equals_the_library(official, ours, text):
    assert ids(ours, text) == official.encode(text)
    assert ours.decode(ours.encode(text)) == official.decode(official.encode(text))


def test_runs_of_spaces(official, ours):
    for n in range(1, 130):
        for text in (" " * n, "a" + " " * n, " " * n + "the"):
            assert ids(ours, text) == official.encode(text), n


def test_random_texts(official, ours):
    rng = random.Random(0)
    letters = "abcdeéßñ the in on er\n\t.,123日本😀ーン▁"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert ids(ours, text) == official.encode(text), repr(text)


def test_the_table(official, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = tr.encode(documents, PIECE_BPE)
    for r in got.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == official.encode(texts[r.doc_id])
    assert {r.doc_id: r.text for r in tr.decode(got, PIECE_BPE).collect()} == texts
    assert all(r.equal for r in tr.round_trip(documents, PIECE_BPE).collect())


def test_edge_rows(make):
    rows = tr.round_trip(make((1, None), (1, ""), (None, "a b"), (2, "word " * 40_000), (2, "x"), (2, "x")), PIECE_BPE)
    assert sorted((str(r.doc_id), r.n_ids > 0, r.equal) for r in rows.collect()) == [
        ("1", False, True), ("1", False, True), ("2", True, True), ("2", True, True), ("2", True, True),
        ("None", True, True)]
    assert tr.round_trip(make(), PIECE_BPE).count() == 0


def test_shortest_path_of_a_unigram_vocabulary():
    machine = tr.Transducer.__new__(tr.Transducer)
    machine.pieces = ["<unk>", "a", "b", "ab", "abb", "bb"]
    machine.score = [0, -1.5, -1.2, -2.0, -9.25, -2.1]
    machine.merges, machine.trie = False, {}
    for i, p in enumerate(machine.pieces[1:], 1):
        node = machine.trie
        for c in reversed(p):
            node = node.setdefault(c, {})
        node[""] = i
    assert machine._path("abb") == [3, 2]  # 3.2, against 3.6 and 3.9
    assert machine._path("azb") == [1, -1 - ord("z"), 2]


def test_words_are_followed_without_weights(ours, monkeypatch):
    """Pieces that follow each other are found arc by arc; other characters go by weights."""
    words = ["▁the", "▁information", "▁eaenat", "▁thheingble", "▁èieuxvi", "éouelleè", "Thwhtionhe", "▁", "0"]
    expected = [ours._path(w) for w in words]
    assert [ours._only_path(w) for w in words] == expected
    assert ours._only_path("a\U0001f9ff") is None
    fresh = tr.Transducer(PIECE_BPE)
    monkeypatch.setattr(fresh, "_path", None)
    assert [np.frombuffer(fresh._ids(w), "<u4").tolist() for w in words] == expected
