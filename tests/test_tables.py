"""Landed answers, stored tables and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet import schemas
from broadsheet.operators import chunks, filters
from broadsheet.operators.dedupe import dedupe_first
from broadsheet.operators.lookup import bucket_of, of_articles
from broadsheet.plans import indexing
from broadsheet.session import fresh_path
from broadsheet.sources import articles as files
from broadsheet.sources import payloads, tables
from broadsheet.sources import store as stores
from broadsheet.streaming import ingest


def land(folder, name, *answers):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(a) + "\n" for a in answers))


def answer(fetch_id, *results, status="success", category="top"):
    return {"fetch_id": fetch_id, "requested_category": category, "status": status, "results": list(results)}


def test_payload_rules(spark, tmp_path):
    land(
        tmp_path / "in", "1.json",
        answer(
            1,
            {"title": "A", "source_name": "s", "description": "a great win", "category": ["x", "y"], "keywords": ["k"]},
            {"title": "", "source_name": "s"},
            {"source_name": "s", "content": "no title"},
            {"title": "B", "source_id": "id", "content": "text", "category": []},
            {"title": "C", "source_name": None, "description": ""},
        ),
        {"fetch_id": 2, "status": "error", "results": {"message": "limit"}},
        answer(3, {"title": "D", "source_name": "s"}, status="error"),
    )
    (tmp_path / "in" / "2.json").write_text("{broken\n")
    rows = payloads.parse_payloads(payloads.read_payloads(spark, str(tmp_path / "in"))).orderBy("title").collect()
    assert [(r.title, r.source_name, r.category, r.description, r.content) for r in rows] == [
        ("A", "s", "x", "a great win", "a great win"),
        ("B", "id", "top", "", "text"),
        ("C", "unknown", "top", "", ""),
    ]
    assert [r.sentiment for r in rows] == ["positive", "neutral", "neutral"]
    assert [r.keywords for r in rows] == [["k"], [], []]
    assert [tuple(r.landed) for r in rows] == [(1, 0), (1, 3), (1, 4)]


def test_union_of_unlike_batches(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(1, "y")], "id int, b string")
    assert sorted(payloads.union_batches(a, b).collect(), key=str) == sorted(
        [(1, "x", None), (1, None, "y")], key=str
    )


def test_dedupe_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.lit(5000) - F.col("id")).alias("at"), F.col("id").alias("v"),
    )
    got = dedupe_first(rows, "k", "at")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan  # whole rows stay where they are
    assert got.count() == 2001
    assert got.filter("k = 'hot'").first().v == 2997


def test_first_rows_among_equal_places_and_missing_keys(spark):
    rows = [("a", 1, "y"), ("a", 1, "x"), ("a", 0, "z"), ("b", 2, "q"), ("b", 2, "p"), ("b", 2, "p"), (None, 5, "n"),
            (None, 4, "m"), ("c", None, "late"), ("c", 3, "c"), ("d", None, "only")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    got = {(r.k, r["at"], r.v) for r in dedupe_first(df, "k", "at").collect()}
    plain = {}
    for k, at, v in rows:  # a missing place comes first, as in any ascending order
        plain[k] = min(plain.get(k, (at, v)), (at, v), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == {(k, *x) for k, x in plain.items()} and dedupe_first(df, "k", "at").count() == len(plain)
    assert dedupe_first(df.limit(0), "k", "at").count() == 0


@pytest.fixture
def store(spark):
    made = stores.create(spark, fresh_path(spark, "store"))
    return made.articles, made.chunks


@pytest.fixture
def whole(spark):
    return stores.create(spark, fresh_path(spark, "store"))


def counted(spark, whole, load_id):
    return {r.counter: r.n for r in ingest.ingest_counts(spark, whole, load_id).collect()}


def article(i, content="c", at=0, category="top"):
    return (f"a{i}", f"title {i}", "", content, "s", category, ["k"], at)


def batch(spark, *rows):
    short = spark.createDataFrame(
        list(rows),
        "article_id string, title string, description string, content string, source_name string,"
        " category string, keywords array<string>, at int",
    )
    missing = [f for f in schemas.ARTICLE.fieldNames() if f not in short.columns]
    return short.select("*", *[F.lit(None).cast("string").alias(m) for m in missing])


def test_insert_first_wins_and_twice_adds_nothing(spark, store):
    path, _ = store
    load = batch(spark, article(1, "late", 5), article(1, "first", 1), article(2))

    def inserted(rows):
        return tables.read_articles(spark, path, tables.insert_new(rows, path, "at")).count()

    assert [inserted(load), inserted(load)] == [2, 0]
    assert inserted(batch(spark, article(2, "other"), article(3))) == 1
    stored = tables.read_articles(spark, path)
    assert {(r.article_id, r.content) for r in stored.collect()} == {("a1", "first"), ("a2", "c"), ("a3", "c")}
    assert stored.columns == schemas.ARTICLE.fieldNames()
    assert stored.filter("created_at IS NULL").count() == 0


def test_lookup_reaches_the_scan_of_sorted_files(spark, store):
    path, _ = store
    tables.insert_new(batch(spark, *[article(i) for i in range(50)]), path, "at")
    found = filters.get_article(tables.read_articles(spark, path), "a7")
    assert found.count() == 1
    assert "EqualTo(article_id,a7)" in found._jdf.queryExecution().executedPlan().toString()
    ids = [
        (r.file, r.article_id) for r in spark.read.parquet(path)
        .select(F.col("_metadata.file_path").alias("file"), "article_id").collect()
    ]
    for file in {f for f, _ in ids}:
        stored = [i for f, i in ids if f == file]
        assert stored == sorted(stored)


def test_create_keeps_what_is_there(spark, store):
    path, _ = store
    tables.insert_new(batch(spark, article(1)), path, "at")
    tables.create_articles(spark, path)
    assert tables.read_articles(spark, path).count() == 1


def failing(message):
    def vectoriser(rows):
        raise RuntimeError(message)
    return vectoriser


def test_articles_and_chunks_are_seen_together_or_not_at_all(spark, whole, tmp_path):
    land(tmp_path / "in", "1.json", answer(1, {"title": "T" * 200, "source_name": "s"}, {"title": "U", "source_name": "s"}))
    landed = payloads.read_payloads(spark, str(tmp_path / "in"))
    with pytest.raises(RuntimeError, match="no model"):  # the try stores articles and stops before their chunks
        ingest.load_batch(landed, whole, "load-7", failing("no model"))
    assert spark.read.parquet(whole.articles).count() == 2
    assert stores.read_articles(spark, whole).count() == stores.read_chunks(spark, whole).count() == 0
    expected = {
        "answers": 1, "rejected": 0, "fetched": 2, "new_inserted": 2, "indexed": 2, "new_chunks": 2,
        "without_vector": 0,
    }
    for _ in range(2):  # the second try, and one more that finds nothing to do
        ingest.load_batch(landed, whole, "load-7")
        assert counted(spark, whole, "load-7") == expected
        assert stores.read_articles(spark, whole).count() == stores.read_chunks(spark, whole).count() == 2
    ingest.load_batch(landed, whole, "load-8")
    assert counted(spark, whole, "load-8") == expected | {"new_inserted": 0, "indexed": 0, "new_chunks": 0}
    assert stores.read_chunks(spark, whole).count() == 2


def test_a_second_delivery_calls_the_model_for_no_stored_chunk(spark, whole, store):
    texts = spark.sparkContext.accumulator(0)

    def embed(batch):
        texts.add(len(batch))
        return [[1.0, 0.0]] * len(batch)

    model = chunks.model_vectors(embed, 2)
    rows = batch(spark, article(1, "x" * 2000), article(2, "y" * 700))
    first = indexing.index_articles(rows, store[1], model).count()
    assert first == texts.value > 4
    more = batch(spark, article(1, "x" * 2000), article(2, "y" * 700), article(3, "z"))
    assert indexing.index_articles(more, store[1], model).count() == 1
    assert texts.value == first + 1


def test_rejects_are_stored_with_their_load(spark, whole, tmp_path):
    land(tmp_path / "in", "1.json", answer(1, {"title": "T", "source_name": "s"}), answer(2, status="error"),
         answer(3, status="error"))
    (tmp_path / "in" / "2.json").write_text('{"fetch_id": 4, "status": "succ\n')
    ingest.ingest_stream(spark, str(tmp_path / "in"), whole.root, str(tmp_path / "cp"), once=True).awaitTermination()
    rejected = stores.read_rejects(spark, whole).collect()
    assert sorted((r.fetch_id or 0, r.reason) for r in rejected) == [(0, "damaged"), (2, "error"), (3, "error")]
    (load_id,) = {r.load_id for r in rejected}
    found = counted(spark, whole, load_id)
    assert found["answers"] == 4 and found["rejected"] == 3 and found["fetched"] == found["new_inserted"] == 1


def test_the_timers_categories_and_the_requests_country(spark, whole, tmp_path):
    asked = answer(1, {"title": "T", "source_name": "s"}, category="health") | {
        "requested_country": "fr", "requested_language": "fr"}
    land(tmp_path / "in", "1.json", asked, answer(2, {"title": "U", "source_name": "s"}, category="sports"),
         answer(3, {"title": "V", "source_name": "s"}))
    ingest.ingest_stream(
        spark, str(tmp_path / "in"), whole.root, str(tmp_path / "cp"), once=True, categories=fixed.TIMER_CATEGORIES
    ).awaitTermination()
    got = {(r.title, r.category, r.country, r.language) for r in stores.read_articles(spark, whole).collect()}
    assert got == {("T", "health", "fr", "fr"), ("V", "top", "us", "en")}


def test_a_load_reads_only_its_buckets(spark, store):
    path, _ = store
    tables.insert_new(batch(spark, *[article(i) for i in range(200)]), path, "at")
    table = tables.stored(spark, path, schemas.STORED_ARTICLE)
    load = batch(spark, article(3), article(777))
    found = of_articles(table, load)
    plan = found._jdf.queryExecution().executedPlan().toString()
    buckets = {r[0] for r in load.select(bucket_of("article_id")).collect()}
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "article_id" in scan.split("PushedFilters")[1] and len(buckets) < 16
    files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert [r.article_id for r in found.collect()] == ["a3"] and len(files) == 1
    every = of_articles(table, batch(spark, *[article(i) for i in range(0, 3000, 2)]))  # beyond FEW_IDS
    assert every.count() == 100


def test_compaction_changes_files_only(spark, whole, tmp_path):
    for n in range(4):
        land(tmp_path / "in", f"{n}.json", *[
            answer(10 * n + i, {"title": f"t{i + n}", "source_name": "s", "content": "text " * 200}) for i in range(10)])
    checkpoint = str(tmp_path / "cp")
    ingest.ingest_stream(spark, str(tmp_path / "in"), whole.root, checkpoint, once=True, files_per_batch=1).awaitTermination()

    def seen():
        articles = sorted((r.article_id, r.content) for r in stores.read_articles(spark, whole).collect())
        return articles, sorted(r.chunk_id for r in stores.read_chunks(spark, whole).collect())

    def files():
        return stores.read_articles(spark, whole).select(F.input_file_name()).distinct().count()

    before, many = seen(), files()
    assert len(stores.visible(spark, whole)) == 4
    stores.compact(spark, whole)
    assert seen() == before and len(stores.visible(spark, whole)) == 1
    assert files() < many
    land(tmp_path / "in", "9.json", answer(99, {"title": "t3", "source_name": "s"}, {"title": "new", "source_name": "s"}))
    ingest.ingest_stream(spark, str(tmp_path / "in"), whole.root, checkpoint, once=True).awaitTermination()
    assert len(seen()[0]) == len(before[0]) + 1


def test_delivered_twice_is_stored_once(spark, store):
    path, _ = store
    tables.insert_new(batch(spark, article(1), article(1), article(1, "c2"), article(2)), path, "at")
    assert tables.read_articles(spark, path).count() == 2


def test_half_stored_chunks_are_completed(spark, store):
    _, path = store
    rows = batch(spark, article(1, "x" * 2000), article(2, "y" * 2000))
    every = indexing.chunks_of(rows, chunks.hashed_vectors)
    part = every.filter("article_id = 'a1' AND chunk_index < 2")
    tables.insert_new_chunks(part, path, rows)
    added = indexing.index_articles(rows, path, chunks.hashed_vectors)
    assert added.count() == every.count() - 2
    stored = tables.read_chunks(spark, path)
    assert stored.count() == stored.select("chunk_id").distinct().count() == every.count()


def test_numeric_category_stays_text(spark, store):
    _, path = store
    rows = batch(spark, article(1, category="007"), article(2, category=None), article(3, category=""))
    indexing.index_articles(rows, path, chunks.hashed_vectors)
    got = {(r.article_id, r.category) for r in tables.read_chunks(spark, path).collect()}
    assert got == {("a1", "007"), ("a2", "general"), ("a3", "general")}
    plan = tables.read_chunks(spark, path).filter("category = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [('a "quoted", value', "line\nbreak\r\nand more ", None, ["x", "y"]), ("  b", "", "v", None)],
        "title string, content string, category string, keywords array<string>",
    )
    files.write_articles_csv(rows, str(tmp_path / "csv"))
    back = files.read_articles_csv(spark, str(tmp_path / "csv"), rows.schema).collect()
    assert sorted(map(tuple, back)) == [
        ("  b", None, "v", "[]"),
        ('a "quoted", value', "line\nbreak\r\nand more ", None, '["x","y"]'),
    ]


def test_stream_equals_one_load(spark, tmp_path, whole):
    landing, streamed = tmp_path / "landing", stores.create(spark, fresh_path(spark, "store"))
    first = [answer(i, {"title": f"t{i % 7}", "source_name": "s", "content": f"text {i} " * 50}) for i in range(10)]
    second = [answer(i, {"title": f"t{i % 9}", "source_name": "s", "content": f"text {i} " * 50}) for i in range(5, 20)]
    checkpoint = fresh_path(spark, "checkpoint")
    for name, answers in (("1.json", first), ("2.json", second)):
        land(landing, name, *answers)
        ingest.ingest_stream(
            spark, str(landing), streamed.root, checkpoint, once=True, files_per_batch=1).awaitTermination()
    ingest.load_batch(payloads.read_payloads(spark, str(landing)), whole, "all")

    def articles(store):
        return {(r.article_id, r.title, r.content) for r in stores.read_articles(spark, store).collect()}

    def pieces(store):
        return sorted((r.chunk_id, r.document) for r in stores.read_chunks(spark, store).collect())

    assert len(articles(whole)) == 9
    assert articles(streamed) == articles(whole)
    assert pieces(streamed) == pieces(whole)


def test_damaged_lines_are_kept_apart_and_cut_files_fail(spark, tmp_path):
    land(tmp_path / "in", "1.json", answer(1, {"title": "T", "source_name": "s"}))
    (tmp_path / "in" / "2.json").write_text('{"fetch_id": 2, "status": "succ\n')
    landed = payloads.read_payloads(spark, str(tmp_path / "in"))
    assert payloads.parse_payloads(landed).count() == 1
    rejected = payloads.rejected_answers(landed).collect()
    assert [(r.reason, r.record) for r in rejected] == [("damaged", '{"fetch_id": 2, "status": "succ')]
    import gzip

    whole = gzip.compress(("\n".join('{"fetch_id": %d, "status": "success"}' % i for i in range(50_000))).encode())
    (tmp_path / "in" / "3.json.gz").write_bytes(whole[:len(whole) // 2])
    with pytest.raises(Exception):  # noqa: B017  the reader's own error
        payloads.read_payloads(spark, str(tmp_path / "in")).select("status", "fetch_id").collect()


def test_another_load_makes_good_what_a_crashed_one_left_out(spark, whole, tmp_path):
    land(tmp_path / "in", "1.json", answer(1, {"title": "T" * 200, "source_name": "s"}))
    landed = payloads.read_payloads(spark, str(tmp_path / "in"))
    with pytest.raises(RuntimeError):
        ingest.load_batch(landed, whole, "load-1", failing("crash"))
    ingest.load_batch(landed, whole, "load-2")
    assert stores.read_articles(spark, whole).count() == stores.read_chunks(spark, whole).count() == 1


def test_an_article_given_twice_has_its_chunks_once(spark, store):
    _, path = store
    rows = batch(spark, article(1, "x" * 2000), article(1, "x" * 2000))
    indexing.index_articles(rows, path, chunks.hashed_vectors)
    stored = tables.read_chunks(spark, path)
    assert stored.count() == stored.select("chunk_id").distinct().count() > 1
