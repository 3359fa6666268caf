import hashlib

from checks.compare import connect, rows_of
from pyspark.sql import functions as F

from broadsheet.llm import merkle
from broadsheet.llm.queries import ORACLES, QUERIES

PAGES = "page_id long, url string, html string, start long, digest string"


def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op7_merkle"](spark, sf)
    cursor = connect(sf).execute(ORACLES["op7_merkle"])
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs


def pages(spark, n):
    rows = [(i, f"http://h/{i % 7}", f"<p>é{i}</p>" * (i % 5), None, "x") for i in range(n)]
    rows += [(None, None, None, 1, "x"), (3, "http://h/3", "again", 1, "x"), (3, "http://h/3", "again", 1, "x")]
    return spark.createDataFrame(rows if n else [], PAGES)


def test_offsets_and_records(spark):
    by = {}
    for r in merkle.archive(pages(spark, 60), shard_records=20).collect():
        by.setdefault(r.shard, []).append(r)
    assert sum(map(len, by.values())) == 63 and len(by) > 1
    for rows in by.values():
        rows.sort(key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(len(rows)))
        at = 0
        for r in rows:
            assert (r.start, r.stop) == (at, at + len(r.record))
            head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
            assert f"Content-Length: {len(rest) - 4}".encode() in head and rest.endswith(b"\r\n\r\n")
            at = r.stop


def damaged(archive):
    record = merkle.damaged(F.col("record"), F.col("page_id"))
    copy = archive.withColumn("record", record).filter("record IS NOT NULL")
    return copy.withColumn("sha256", F.sha2("record", 256))


def test_descends_to_the_damage(spark):
    records = merkle.archive(pages(spark, 300), shard_records=40).cache()
    same = merkle.audit(records, records).collect()
    assert len(same) == 303 and {r.state for r in same} == {"ok"}
    got = {(r.shard, r.seq): r for r in merkle.audit(records, damaged(records)).collect()}
    for r in records.collect():
        found = got[r.shard, r.seq]
        expected = "missing" if r.page_id in (5, 216) else "altered" if r.page_id in (7, 108, 209) else "ok"
        assert found.state == expected
        assert found.sha256 == hashlib.sha256(r.record).hexdigest()
        assert (found.replica_sha256 == found.sha256) == (expected == "ok")
    lost = merkle.audit(records, records.filter("shard != 1")).collect()
    assert {r.shard for r in lost if r.state == "missing"} == {1}


def test_records_that_only_the_replica_has(spark):
    records = merkle.archive(pages(spark, 60), shard_records=20).cache()
    last = records.filter("shard = 0").orderBy(F.desc("seq")).limit(1)
    more = last.selectExpr(
        "77777L AS page_id", "shard", "record", "length", "sha256", "seq + 1 AS seq", "stop + length AS stop",
        "stop AS start")
    beyond = more.withColumn("shard", F.lit(40).cast("long"))  # a shard of its own
    got = merkle.audit(records, records.unionByName(more).unionByName(beyond)).collect()
    extra = [r for r in got if r.state == "extra"]
    assert len(got) == 65 and {r.shard for r in extra} == {0, 40} and {r.page_id for r in extra} == {77777}
    assert {r.state for r in got if r not in extra} == {"ok"} and all(r.sha256 is None for r in extra)


def test_records_that_moved(spark):
    records = merkle.archive(pages(spark, 60), shard_records=20).cache()
    moved = records.withColumn("start", F.col("start") + 100).withColumn("stop", F.col("stop") + 100)
    got = merkle.audit(records, moved.filter("shard = 1").unionByName(records.filter("shard != 1"))).collect()
    assert len(got) == 63 and {(r.state, r.shard == 1) for r in got} == {("moved", True), ("ok", False)}
    assert all(r.sha256 == r.replica_sha256 for r in got)


def test_a_very_long_page(spark):
    docs = spark.createDataFrame([(1, "http://a", "é" * 3_000_000, None, "x"), (2, None, "b", None, "x")], PAGES)
    got = {r.page_id: r for r in merkle.audit_copy(docs).collect()}
    assert got[1].length > 6_000_000 and got[2].start == got[1].length and got[1].state == "ok"


def test_empty_table(spark):
    assert merkle.audit_copy(pages(spark, 0)).count() == 0
