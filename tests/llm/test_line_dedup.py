import difflib
import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from broadsheet.llm import line_dedup as ld
from broadsheet.llm.queries import QUERIES


def patience(a, b):
    """Plain recursive patience diff: matched (i, j)."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return patience(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [x for x in b if a.count(x) == 1 and b.count(x) == 1]
    seconds = [a.index(x) for x in once]
    length = []
    for k in range(len(once)):  # of longest increasing subsequences that end here, quadratic
        length.append(1 + max((length[m] for m in range(k) if seconds[m] < seconds[k]), default=0))
    chain, k = [], len(once)
    for n in range(max(length, default=0), 0, -1):  # from the end, always the latest that fits
        k = max(m for m in range(k) if length[m] == n and (not chain or seconds[m] < seconds[chain[0]]))
        chain.insert(0, k)
    if not chain:
        return []
    out, i0, j0 = [], 0, 0
    for k in chain:
        i, j = seconds[k], b.index(once[k])
        out += [(i0 + x, j0 + y) for x, y in patience(a[i0:i], b[j0:j])] + [(i, j)]
        i0, j0 = i + 1, j + 1
    return out + [(i0 + x, j0 + y) for x, y in patience(a[i0:], b[j0:])]


def test_alignment_is_common_and_in_order():
    rng = random.Random(0)
    for _ in range(400):
        a = [rng.randint(0, 9) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 9) for _ in range(rng.randint(0, 14))]
        got, plain = ld.align(a, b), patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == len(plain)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    long = list(range(2000))
    assert ld.align(long, long[500:] + long[:500]) == [(i, i - 500) for i in range(500, 2000)]


def keys_of(own, block):
    """A document's lines and shortest runs of `block` characters from and up to shorter lines."""
    found = {("line", x): len(x) for x in own if x.strip(" ")}
    for way, lines in ((1, own), (-1, own[::-1])):
        lines = [x if x.strip(" ") else "" for x in lines]
        for i, x in enumerate(lines):
            to = next((j for j in range(i + 1, len(lines) + 1) if sum(map(len, lines[i:j])) >= block), None)
            if x and to and to > i + 1:
                found["run", way, *lines[i:to]] = block
    return found


def brute(rows, rare=ld.RARE, block=ld.BLOCK_CHARS):
    """Rows in order with the lines that go; pairs by plain loops over all documents."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    lines = [(t or "").split("\n") for _, t in order]
    keys = [keys_of(own, block) for own in lines]
    holders = {}
    for k, own in enumerate(keys):
        for x in own:
            holders.setdefault(x, []).append(k)
    out = []
    for k, own in enumerate(lines):
        met = {}
        for x in keys[k]:
            if holders[x][0] != k:
                met.setdefault(holders[x][0], []).append(x)
        gone = set()
        for first, common in met.items():
            if min(len(holders[x]) for x in common) > rare and sum(keys[k][x] for x in common) < block:
                continue
            a, b = ([x if x.strip(" ") else "" for x in s] for s in (lines[first], own))
            run = []
            for i, j in [*patience(a, b), (-9, -9)]:
                if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
                    if sum(len(own[y]) for _, y in run) >= block:
                        gone.update(y for _, y in run)
                    run = []
                run.append((i, j))
        kept = "\n".join(x for y, x in enumerate(own) if y not in gone)
        out.append((str(order[k][0]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def ours(docs):
    return sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in ld.summary(docs).collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = ours(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[1] for r in got) > 20
    assert got == sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in QUERIES["op1_line_dedup"](
        spark, f"/root/testdata/sf{sf}").collect())


def test_copies_boilerplate_and_edges(make):
    page = [f"A line that says something of its own, number {i}, at length" for i in range(12)]
    notice = "This notice stands in very many documents, word for word."
    rows = [(i, "\n".join([notice, f"Text {i} which nobody else has in this table"])) for i in range(60)]
    rows += [(100, "\n".join(page)), (101, "\n".join(page[3:9] + ["new"])), (102, "\n".join(page[6:] + page[:6])),
             (103, "\n".join(["x", *page[:2], "", *page[2:4], "", "y"]))]
    rows += [(200 + i, "\n".join(page)) for i in range(50)]       # copies: none of the lines is rare
    rows += [(300, None), (301, ""), (302, "\n\n \n"), (None, "\n".join(page[2:6]))]
    got = ours(make(*rows))
    assert got == brute(rows)
    by = {r[0]: r[1] for r in got}
    assert by["5"] == 1 and by["0"] == 0 and by["100"] == 0 and by["101"] == 6 and by["230"] == 12 and by["None"] == 4
    kept = ld.without_repeats(make(*rows))
    assert kept.columns == make().columns
    ids = [r.doc_id for r in kept.collect()]
    assert 230 not in ids and {5, 100, 101, 300, 301, 302} <= set(ids)


def test_a_very_long_document(make):
    lines = [f"line {i} of a very long document" for i in range(40_000)]
    got = ours(make((1, "\n".join(lines)), (2, "\n".join(["own", *lines[5:20_000]])), (3, "x" * 2_000_000)))
    assert [r[:2] for r in got] == [("1", 0), ("2", 19_995), ("3", 0)]


def test_repeated_rows(make):
    page = "\n".join(f"A line that says something of its own, number {i}, at length" for i in range(5))
    got = ours(make((1, page), (1, page), (1, page), (0, "other")))
    assert [r[:2] for r in got] == [("0", 0), ("1", 0), ("1", 5), ("1", 5)]
    assert ours(make()) == []


def test_agrees_with_a_line_diff_on_simple_edits():
    rng = random.Random(4)
    a = [f"l{i}" for i in range(300)]
    b = [x for x in a if rng.random() > 0.1]
    assert len(ld.align(a, b)) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def queried(docs, folder):
    """What the registered query gives for a table of these documents."""
    docs.write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op1_line_dedup"](docs.sparkSession, str(folder)).collect()
    return sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in found)


def test_frequent_blocks_go_at_every_frequency(make, tmp_path):
    notice = "This notice stands in very many documents, word for word."
    short = ["Ends with three lines", "none of them as long", "as a block has to be"]
    rows = [(i, "\n".join([notice, f"Text {i} which nobody else has in this table", *short])) for i in range(60)]
    rows += [(100 + i, "\n".join([f"Other text {i} of one document only", short[0]])) for i in range(40)]
    got = queried(make(*rows), tmp_path)
    assert got == brute(rows)
    by = {r[0]: r[1] for r in got}
    assert by["0"] == 0 and {by[str(i)] for i in range(1, 60)} == {4}
    assert {by[str(100 + i)] for i in range(40)} == {0}


def test_runs_of_short_lines_point_to_their_own_holder(make, tmp_path):
    first, second = "The first of these two lines is short", "and the second one, too"
    rows = [(i, "\n".join([first, f"a{i}"])) for i in range(40)]
    rows += [(100 + i, "\n".join([f"b{i}", second])) for i in range(40)]
    rows += [(200, f"c\n{first}\n{second}"), (201, f"{first}\n{second}\nd"), (202, f"e\n\n{first}\n{second}"),
             (203, f"{first}\n\n{second}\nf"), (204, f"g\n{first}\n\n{second}")]
    rows += [(300, "\n".join(["again"] * 9)), (301, "\n".join(["x", *["again"] * 9]))]
    by = {r[0]: r[1] for r in queried(make(*rows), tmp_path)}
    assert [by[str(i)] for i in range(200, 205)] == [0, 2, 2, 0, 3]
    assert by["300"] == 0 and by["301"] == 9
    assert not any(by[str(i)] or by[str(100 + i)] for i in range(40))


def test_runs_equal_plain_loops():
    rng, size = random.Random(2), {0: 0, 5: 3, -7: 10, 9: 25, 11: 45}
    for _ in range(100):
        lines = [[rng.choice([0, *size]) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 6))]
        expected = []
        for own in lines:
            expected.append([])
            for way, x in ((1, own), (-1, own[::-1])):
                for i in range(len(x)):
                    to = next((j for j in range(i + 1, len(x) + 1) if sum(size[y] for y in x[i:j]) >= 40), None)
                    if x[i] and to and to > i + 1:
                        expected[-1].append((way, *x[i:to]))
        chars = [[size[x] for x in own] for own in lines]
        got = ld.runs(pa.array(lines, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32())), 40).to_pylist()
        assert [len(x) for x in got] == [len(x) for x in expected]
        assert sorted(Counter(h for x in got for h in x).values()) == sorted(
            Counter(r for x in expected for r in x).values()
        )


def test_a_short_line_behind_a_long_one(make, tmp_path):
    long, short = "A line of its own length, which other documents have as well", "A short line behind it"
    rows = [(i, f"{long}\na{i}") for i in range(40)] + [(100 + i, f"b{i}\n{short}") for i in range(40)]
    rows += [(200, f"c\n{long}\n{short}"), (201, f"{long}\n{short}\nd")]
    by = {r[0]: r[1] for r in queried(make(*rows), tmp_path)}
    assert by["0"] == 0 and by["1"] == 1 and by["100"] == by["139"] == 0
    assert by["200"] == 1 and by["201"] == 2
