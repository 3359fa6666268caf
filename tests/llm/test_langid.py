import zlib

import numpy as np
from pyspark.sql import functions as F

from broadsheet.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in langid.predict_all(docs).collect()}
    assert set(got) == set(truth)
    right = total = 0
    for doc, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.held_out and any(c.isalpha() for c in truth[doc].text):
            total += 1
            right += r.lang_pred == truth[doc].lang
    assert right >= 0.93 * total, (right, total)


def test_edge_rows(make):
    docs = make((1, None), (2, ""), (3, "12 ²½ _"), (None, "the and of"), (4, "the " * 50_000),
                (5, "the and of"), (5, "the and of"), (8, "the and"), (9, "of the"))
    got = langid.predict_all(docs).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == by[5].lang_pred == by[None].lang_pred == "en" and by[None].held_out
    assert langid.predict_all(make()).count() == 0


def test_unseen_words_back_off():
    model = langid.Model(["a", "b"], langid.Table.of({"xy": (-1.0, -2.0)}, 2), langid.Table.of(
        {"_q": (-1.0, -3.0), "_": (-2.0, -2.0), "z": (-5.0, -1.0), "_qz": (-0.5, -4.0)}, 2))
    scores = langid.Scores(model)
    assert scores.of(["xy"]).tolist() == [-1.0, -2.0]
    assert scores.of(["qz"]).tolist() == [-2.5, -6.0]      # _qz, then _
    assert scores.of(["q!z"]).tolist() == [-1.0 - 5 - 2, -3.0 - 1 - 2]  # _q, nothing, z, _


def test_rejects_what_cannot_be_told(make):
    docs = make((1, None), (2, "!!!"), (3, "the and of"), (6, "the of"))
    kept = langid.reject(docs, langid.fit(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6]


def test_keeps_what_has_a_letter_where_nothing_was_learnt(make):
    docs = make((1, None), (2, "12 ²½ _!"), (3, "the and of"), (6, "é"), (None, "1 x"), (7, ""))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    nothing_read = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("12")).otherwise(F.lit(None)))
    for rows in (unlabelled, docs.filter(langid.held_out())):
        assert not len(langid.fit(rows).words)
        kept = langid.reject(rows, langid.fit(rows))
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows.collect()} & {3, 6, None}
    assert {r.doc_id for r in langid.reject(docs, langid.fit(nothing_read)).collect()} == {3, 6, None}


def test_clashing_columns(make):
    docs = make((1, None), (3, "the and of"), (6, "the of"))
    for name in ("_text", "_lang_pred", "_score", "`odd name`", "__text"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    kept = langid.reject(docs, langid.fit(docs))
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == [3, 6]


def test_every_language_has_its_sample(spark):
    rows = [(i, "uno dos tres", "es") if i % 50 == 0 else (i, "one two three", "en") for i in range(3000)]
    rows += [(5000 + i, "same same", lang) for i, lang in enumerate(["aa", "zz"] * 20)]  # a tie
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=30)
    assert model.languages == ["aa", "en", "es", "zz"]
    by = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert by[0] == by[50] == "es" and by[1] == "en" and by[5000] == by[5001] == "aa"


def test_scores_by_plain_code(spark):
    """Held-out documents, scored word by word and n-gram by n-gram from the model's tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    words, grams = (dict(zip(t.names.to_pylist(), t.scores.tolist(), strict=True)) for t in (model.words, model.grams))

    def rows_of(word):
        if word in words:
            return [words[word]]
        marked, at, out = f"_{word}_", 0, []
        while at < len(marked):
            n = next((n for n in range(5, 0, -1) if marked[at:at + n] in grams and at + n <= len(marked)), 0)
            if n:
                out.append(grams[marked[at:at + n]])
            at += n or 1
        return out

    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        found = langid._WORD.findall(r.text.lower())
        if not any(map(str.isalpha, found)):
            continue
        sums = np.array([s for w in found for s in rows_of(w)]).sum(axis=0) / np.sqrt(len(found))
        share = np.exp(sums - sums.max())
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmax(share))]
        assert abs(got[r.doc_id].score - (share / share.sum()).max()) < 1e-6
