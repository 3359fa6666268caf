import hashlib
import random
import zlib

import pytest
from checks.compare import connect, rows_of

from broadsheet.llm import manifest, running
from broadsheet.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(levels, at, fold, siblings):
    for nodes in levels[:-1]:
        start = at - at % 8
        left, right = nodes[start:at], nodes[at + 1:start + 8]
        siblings += left + right
        fold, at = sha(*left, fold, *right), at // 8
    return fold


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """The result, with the rows of each language in order of id and leaf."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels_of([x[2] for x in groups[g]])
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (*_, leaf, r) in enumerate(groups[g]):
            other = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                other = brute_leaf(r[0], lowered(r[1]), *r[2:])
            siblings = []
            fold = climb(top, k, climb(trees[g], i, other, siblings), siblings)
            root = top[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], root, sha(*siblings), fold, fold == root))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op12_manifest"](spark, sf)
    cursor = connect(sf).execute(ORACLES["op12_manifest"])
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs


@pytest.mark.parametrize("n", [0, 1, 2, 9, 700])
def test_against_plain_code(spark, n):
    rng = random.Random(n)
    rows = [
        (rng.choice([i, i * 97, -i, (i << 40) + 5]) if i else 0, rng.choice(["Ab É", "", None, "XyZ" * 50]) ,
         rng.choice(["en"] * 6 + ["de", None, "", "z"]), rng.choice(["s", None]), rng.choice([3, None]))
        for i in range(n)
    ]
    if n > 9:
        rows += rows[:20] + rows[:5]  # repeated rows
        rows += [(None, f"T{i}", "en", None, None) for i in range(30)]  # none of them has an id
        rows += [(17, f"T{i}", "en", None, None) for i in range(90)]  # one id, many texts
        rows += [(i, "dense", "fr", "q", 5) for i in range(600)]  # more than one block
        rows += [(1 << 50, "long " * 200_000, "fr", "q", 5), (-(1 << 63), "A", "fr", "q", 5), ((1 << 63) - 1, "A", "fr", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "leaf", "place", "digest", "path", "word", "presented"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    assert ordered(manifest.verified_documents(docs).collect()) == ordered(brute(rows))


def test_paths_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"l{i % 70:02}", "s", 1) for i in range(630)], SCHEMA)
    for r in manifest.proofs(manifest.document_leaves(docs)).collect():
        node = r.leaf
        for step in r.path:
            node = sha(step["left"], node, step["right"])
        assert node == r.root and len(r.path) == 5  # 9 documents of a language, 70 languages


def test_running_totals(spark):
    rng = random.Random(5)
    keys = {(rng.choice("ab"), rng.choice([rng.randrange(50), rng.randrange(-(1 << 62), 1 << 62)])) for _ in range(300)}
    rows = [(g, k, rng.randrange(9)) for g, k in keys]
    got = running.running(spark.createDataFrame(rows, "g string, k long, n long"), "g", "k", "n").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.before == sum(n for g, k, n in rows if g == r.g and k < r.k)
        assert r.total == sum(n for g, _, n in rows if g == r.g)


def test_places_and_copies(spark):
    names = [f"n{i:03}" for i in range(500)]
    shuffled = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, 500)], "name string")
    got = running.numbered(shuffled.repartition(7), "name").collect()
    assert sorted((r.place, r.name) for r in got) == list(enumerate(names))
    times = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10_000)], "v string, n long")
    made = running.repeated(times, "n").collect()
    assert sorted((r.v, r.copy) for r in made) == [("b", 0), *(("c", i) for i in range(10_000))]
