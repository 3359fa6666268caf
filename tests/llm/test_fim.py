import hashlib
import random
import re

import pytest
from checks.compare import connect, rows_of

from broadsheet.llm import fim
from broadsheet.llm.queries import ORACLES, QUERIES

CLASHING = ("output", "form", "n", "pieces", "_output", "_form", "drawn", "restored")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    name = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(name[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op11_fim"](spark, sf)
    cursor = connect(sf).execute(ORACLES["op11_fim"])
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    alphabet = "abZ \n<>PSMé語😀-_'0\u0000"
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, None), (None, "no id at all"), (7, "twice"), (7, "twice")]
    rows += [(1100 + i, t) for i, t in enumerate(("<P>", "a<S>b", "x<M", "<", "<<M>>", "P>", "<P", "S><", "<S"))]
    rows += [(1200 + i, "<S" * 5 + "<P") for i in range(20)]  # starts of sentinels at the cuts
    rows += [(2000 + i, ("Wörter und 語 " * 40_000) + str(i)) for i in range(3)]  # very long
    rows += [(-5, "a" * 300_000), (1 << 62, "é" * 9000)]
    return rows


def test_against_plain_code(spark, make, odd):
    docs = make(*odd)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    made = fim.arranged(docs)
    got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(got, key=key) == sorted((brute(*r) for r in odd), key=key)
    assert made.filter("output_sha256 != sha2(output, 256)").count() == 0
    back = fim.restored(made, ("doc_id", "output")).collect()
    assert sorted((r.doc_id or 0, r.restored) for r in back) == sorted((i or 0, t or "") for i, t in odd)
    assert all(r.restored_sha256 == sha(r.restored) for r in back)
    digests = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.round_trip(docs).collect()]
    assert sorted(digests, key=key) == sorted(
        ((i, sha(brute(i, t)[-1]), sha(t or "")) for i, t in odd), key=key)


def test_descriptors_show_the_output(make, odd):
    rows = fim.arranged(make(*odd)).collect()
    texts = {(i, len(t or "")): t or "" for i, t in odd}
    sentinels = b"<P><S><M>"
    for r in rows:
        text = next(t for (i, _), t in texts.items() if i == r.doc_id and brute(i, t)[-1] == r.output).encode()
        buffers = (text, sentinels)
        shown = b"".join(buffers[p.buffer][p.start:p.start + p.length] for p in r.pieces)
        assert shown.decode() == r.output
        assert sum(p.length for p in r.pieces if p.buffer == fim.TEXT) == len(text)


def test_shares(make):
    made = fim.arranged(make(*((i, "some words here") for i in range(2000))), plain_from=50, spm_below=100)
    forms = {r.form: r["count"] for r in made.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 900 < forms["spm"] < 1100


def test_marks():
    import numpy as np

    marked = np.random.default_rng(1).random(10_000) < 0.3
    marks, places = fim.Marks(marked), np.flatnonzero(marked)
    assert [marks.select(k) for k in range(len(places))] == places.tolist()
    assert marks.select(len(places)) == 10_000
    assert all(marks.rank(i) == marked[:i].sum() for i in (0, 1, 4095, 4096, 4097, 9999, 10_000))
    assert fim.Marks(np.zeros(0, bool)).rank(0) == 0


def test_empty_table(make, spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.round_trip(empty).count() == 0


def test_an_output_without_its_sentinels_fails(spark):
    rows = spark.createDataFrame([(1, "no sentinels", "psm")], "doc_id long, output string, form string")
    with pytest.raises(Exception, match="ValueError|not found"):
        fim.restored(rows).collect()
