import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import mixture
from broadsheet.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above the most a source can get is dealt out again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, open_ = float(sum(sizes.values())), set(names)
    while rest > 1e-6 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def brute_mix(rows, uniform, most=3, tilt=0.25):
    """(doc_id, size, source_size, target, taken) by plain code; `uniform` has the drawn numbers."""
    sizes = Counter({r[3]: 0 for r in rows})
    for r in rows:
        sizes[r[3]] += count(r[1])
    target, out = brute_targets(sizes), []
    for source in sizes:
        versions = Counter((r[0], r[1]) for r in rows if r[3] == source)
        of = {v: count(v[1]) for v in versions}
        bits = {v: of[v].bit_length() for v in versions}
        classes = sorted(set(bits.values()))
        words = [sum(versions[v] * of[v] for v in versions if bits[v] == k) for k in classes]
        number = dict(zip(classes, mixture.expected(
            words, [2 ** (-tilt * k) for k in classes], target[source], most), strict=True))
        whole = {k: int(c + 1e-9) for k, c in number.items()}
        chance = {k: c - whole[k] if c - whole[k] > 1e-9 else 0.0 for k, c in number.items()}
        drawn = [v for v in versions if chance[bits[v]]]
        docs = sum(versions[v] for v in drawn)
        left = sum(chance[bits[v]] * versions[v] * of[v] for v in drawn)
        mean = sum(chance[bits[v]] * versions[v] for v in drawn) / docs if docs else 0.5
        odds = lambda p: p / (1 - p)
        ranges = max(1, docs // mixture.RANGE_ROWS)
        rank = {}
        for v in drawn:
            q = odds(uniform[source, v]) / odds(chance[bits[v]]) * odds(mean)
            rank[v] = q / (1 + q)
        at = {v: min(int(rank[v] * ranges), ranges - 1) for v in drawn}
        taken, cut = Counter(), None
        for k in range(ranges):
            here = sum(versions[v] * of[v] for v in drawn if at[v] == k)
            if left < here:
                cut = k
                break
            left -= here
        for v in drawn:
            taken[v] = versions[v] if cut is None or at[v] < cut else 0
        if cut is not None:
            zone = sorted((v for v in drawn if at[v] in (cut, cut + 1)), key=lambda v: rank[v])
            for v in zone:
                taken[v] = min(versions[v], int(left // of[v]))
                left -= taken[v] * of[v]
            while True:
                nearest, best = abs(left), (None, None)
                for give in [None, *(v for v in zone if taken[v])]:
                    for get in [None, *sorted((v for v in zone if taken[v] < versions[v]), key=lambda v: of[v])]:
                        off = abs(left + (of[give] if give else 0) - (of[get] if get else 0))
                        if off < nearest:
                            nearest, best = off, (give, get)
                if best == (None, None):
                    break
                for v, n in zip(best, (-1, 1), strict=True):
                    if v:
                        taken[v] += n
                        left -= n * of[v]
        for v, n in versions.items():
            for i in range(n):
                copies = whole[bits[v]] + (i < taken[v])
                out.append((v[0], of[v], sizes[source], target[source], copies * of[v]))
    return out


def drawn_numbers(docs):
    hashed = F.xxhash64(F.lit(0), mixture._source(F.col("source")), "doc_id", F.xxhash64("text"))
    u = ((F.shiftrightunsigned(hashed, 11) + 0.5) / float(1 << 53)).alias("u")
    return {(r.source, (r.doc_id, r.text)): r.u for r in docs.select("source", "doc_id", "text", u).collect()}


def check(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3], r[4])
    got, expected = sorted((tuple(r) for r in got), key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert (*a[:3], a[4]) == (*b[:3], b[4]) and a[3] == pytest.approx(b[3], rel=1e-9)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = QUERIES["op13_mixture"](spark, f"/root/testdata/sf{sf}").collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check(got, brute_mix(rows, drawn_numbers(docs)))
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.size == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
    assert all(abs(taken[source[r.doc_id]] - r.target) <= (0.2 if len(rows) < 999 else 0.01) * r.target for r in got)


def odd_rows():
    rng = random.Random(2)
    text = lambda: " ".join(["w é"] * rng.choice([0, 1, 3, 20, 200]))
    rows = [(i, text(), None, rng.choice(["a"] * 6 + ["b", "c", "é", "\U0001f600", "", None]), None) for i in range(1500)]
    rows += [(i, None, None, "a", 1) for i in range(5)] + [(None, "no id " * 9, None, "b", 1)] * 7
    rows += [(3, "same row", None, "c", 1)] * 40 + [(9000, "long text " * 60_000, None, "b", 1)]
    rows += [(9001, " \t\n\x0b\x0c\r ", None, "only blank", 1), (9002, "\x1c\x85 x", None, "z", 1)]
    return rows


def test_odd_rows_and_what_is_mixed(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "rows", "_src", "_key", "_n", "src", "rank", "range", "open", "copy", "whole"):
        docs = docs.withColumn(name, F.lit("x"))
    got = mixture.mix(docs).collect()
    check(got, brute_mix(rows, drawn_numbers(docs)))
    assert sorted(map(str, got)) == sorted(map(str, mixture.mix(docs.repartition(7)).collect()))
    mixed = mixture.mixed(docs)
    assert mixed.columns == docs.columns
    counted = Counter()
    for r in mixed.select("doc_id", "text").collect():
        counted[r.doc_id] += count(r.text)
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    assert +counted == +taken


def test_targets_stop_at_three_times_the_size(spark):
    cases = [
        {"a": 1, "b": 1000, "c": 10}, {"a": 10, "b": 10, "c": 10, "d": 10_000, "e": 3, None: 50},
        {"a": 0, "b": 0}, {"a": 7}, {"a": 0, "b": 5, "c": 5, "d": 90},
    ]
    for sizes in cases:
        rows = [("1" if s is None else f"0{s}", n) for s, n in sizes.items()]
        got = mixture.targets(spark.createDataFrame(rows, "src string, source_size long")).collect()
        expected = {("1" if s is None else f"0{s}"): t for s, t in brute_targets(sizes).items()}
        assert {r.src: pytest.approx(r.target, rel=1e-9) for r in got} == expected


def test_chances_are_unequal_and_held(spark):
    """Over many draws a document is taken as often as its class is expected."""
    docs = spark.createDataFrame(
        [(i, "w " * (4 if i % 2 else 64), None, "a" if i < 300 else "b", None) for i in range(600)], SCHEMA)
    seen, draws = Counter(), 12
    for seed in range(draws):
        for r in mixture.mix(docs, seed=seed, weights=(5, 3)).filter("doc_id >= 300").collect():
            seen[r["size"]] += r.taken / r["size"]
    words = 150 * (4 + 64)
    own = mixture.expected([150 * 4, 150 * 64], [2 ** -0.75, 2 ** -1.75], 2 * words * 3 / 8)
    assert own[0] > 1.5 * own[1]
    for size, number in zip((4, 64), own, strict=True):
        assert seen[size] / (150 * draws) == pytest.approx(number, rel=0.05)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixture.mix(empty).count() == 0 and mixture.mixed(empty).count() == 0
