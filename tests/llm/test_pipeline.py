from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from broadsheet.llm.common import stored
from broadsheet.llm.queries import QUERIES
from tests.llm.conftest import CLASHING
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_packing import check as check_packed
from tests.llm.test_secrets import brute as brute_secrets


@pytest.fixture(scope="module")
def steps(spark, documents, sf_dir):
    out, docs = [documents], documents
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay_those_of_documents(steps, documents):
    for df in steps[1:-1]:
        assert df.dtypes == documents.dtypes
    for df in steps[2:-1]:
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_language_keeps_clean_documents(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert all(after[d] == before[d] for d in after)
    gone = [before[d] for d in before if d not in after]
    assert all(not any(c.isalpha() for c in r.text or "") or len(r.text.split()) < 12 for r in gone)
    assert len(gone) < 0.05 * len(before)


def test_lines(steps):
    before, after = rows(steps[1]), rows(steps[2])
    found = {int(d): n for d, n, _ in brute_lines([(r.doc_id, r.text) for r in before.values()])}
    for doc, r in before.items():
        if not found[doc]:
            assert after[doc] == r
        else:
            assert doc not in after or after[doc].text.count("\n") == r.text.count("\n") - found[doc]
    assert any(found.values()) and len(after) < len(before)


def test_one_of_each_group(steps):
    before, after = rows(steps[2]), rows(steps[3])
    components = brute_components([(r.doc_id, r.text) for r in before.values()])
    assert set(after) == {int(c) for d, n, c in components if n} | {int(d) for d, n, _ in components if not n}
    assert all(after[d] == before[d] for d in after)


def test_secrets_are_gone(steps, spark, sf_dir):
    more = spark.createDataFrame([(10**6, "é password=abcdefgh end", "en", "s", 1)], steps[3].schema)
    docs = steps[3].unionByName(more)
    before, after = rows(docs), rows(cp.secret_scan(spark, docs, sf_dir))
    assert set(before) == set(after) and after[10**6].text == "é <secret> end" and after[10**6].n_chars == 14
    for doc, r in before.items():
        if brute_secrets(r.text):
            assert "<secret>" in after[doc].text and not brute_secrets(after[doc].text)
        else:
            assert after[doc].text == r.text


def test_packed_whole(steps, spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in steps[4].collect()]
    check_packed(steps[5].collect(), docs, 4096)
    same = Counter(map(tuple, cp.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()))
    assert same == Counter(map(tuple, steps[5].select("doc_id", "piece", "ids_crc32").collect()))


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_empty_documents(spark, documents, sf_dir):
    docs = documents.filter("false")
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_columns_of_any_name_are_carried_along(spark, documents, sf_dir):
    docs = documents
    for name in (*CLASHING, "an odd name", "__id", "lines", "chars", "spans2"):
        docs = docs.withColumn(name, F.lit("x"))
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == names
    plain = documents
    for name, stage in cp.STAGES[:-1]:
        plain = stored(stage(spark, plain, sf_dir), name)
    assert sorted(docs.select("doc_id", "text").collect()) == sorted(plain.select("doc_id", "text").collect())
    assert stage_of("best_fit_packing")(spark, docs, sf_dir).count() > 0


def stage_of(name):
    return dict(cp.STAGES)[name]


def test_very_long_texts(spark, documents, sf_dir):
    words = " ".join(f"the word {i} of and" for i in range(60_000))
    long = spark.createDataFrame(
        [(10**6, words, "en", "s", len(words)), (10**6 + 1, words + " token=abcdefgh99", "en", "s", 0)], documents.schema)
    docs = documents.limit(50).unionByName(long)
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    kept = [r for r in docs.collect() if r.doc_id >= 10**6]
    assert [r.doc_id for r in kept] == [10**6]  # near copies: one of them stays
    packed = cp.packed(spark, docs, sf_dir).filter(f"doc_id = {10**6}").collect()
    assert len(packed) > 50 and sum(r.length for r in packed) > 200_000


def test_missing_values_and_repeated_rows(spark, documents, sf_dir):
    text = " ".join(f"the word{i}" for i in range(30))
    odd = spark.createDataFrame(
        [(None, text, None, None, None), (5, None, "en", "s", None), (6, "", "en", "s", 0),
         (7, text, "en", None, 1), (7, text, "en", None, 1), (8, "the end", "xx", "s", 7)],
        documents.schema,
    ).unionByName(documents)
    for name, stage in cp.STAGES:
        odd = stored(stage(spark, odd, sf_dir), name)
    assert odd.filter("doc_id = 7").count() <= documents.filter("doc_id = 7").count() + 1
