"""Recurring ingest of landed answers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet import fixed_values as fixed
from broadsheet import schemas
from broadsheet.operators.chunks import chunk_articles, chunk_metadata, hashed_vectors
from broadsheet.plans.indexing import Vectoriser
from broadsheet.sources import payloads, tables
from broadsheet.sources import store as stores
from broadsheet.sources.store import Store

COUNTERS = ("answers", "rejected", "fetched", "new_inserted", "indexed", "new_chunks")


def load_batch(
    landed: DataFrame,
    store: Store,
    load_id: str | None = None,
    vectoriser: Vectoriser | None = hashed_vectors,
) -> str:
    """Store the new articles of some landed answers with their chunks, and what was rejected.

    All of it becomes visible at once, when the load is committed. A load that has ended is not
    done again; one that failed leaves nothing that is read, and its next try starts anew. As
    articles never are without their chunks, only new articles are cut and given vectors. Without a
    vectoriser articles alone are stored.
    """
    load_id = load_id or uuid.uuid4().hex
    spark = landed.sparkSession
    if not stores.commit_of(spark, store, load_id).isEmpty():
        return load_id
    write_id = f"{load_id}.{uuid.uuid4().hex[:8]}"  # a try of its own
    landed = landed.persist()  # read for its articles, for their ids, and for what is rejected
    try:
        articles = payloads.parse_payloads(landed)
        tables.insert_new(articles, store.articles, payloads.LANDED, write_id, stores.visible(spark, store))
        added = tables.read_articles(spark, store.articles, write_id)
        if vectoriser is not None:
            chunks = chunk_metadata(chunk_articles(added))
            tables.append_chunks(chunks, store.chunks, write_id, vectoriser)
        rejected = payloads.rejected_answers(landed).withColumn("load_id", F.lit(write_id))
        rejected.select(*schemas.REJECT.fieldNames()).write.mode("append").partitionBy("load_id").parquet(store.rejects)
        counters = _counters(spark, store, landed, write_id)
    finally:
        landed.unpersist()
    stores.commit(spark, store, load_id, write_id, **counters)
    return load_id


def _counters(spark: SparkSession, store: Store, landed: DataFrame, write_id: str) -> dict[str, int]:
    """What a load has done; of what it has written only narrow columns are read."""
    answers = landed.agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(payloads.is_rejected()).alias("rejected"),
        F.coalesce(F.sum(payloads.delivered()), F.lit(0)).alias("fetched"),
    ).first()
    chunks = tables.read_chunks(spark, store.chunks, write_id)
    indexed = chunks.agg(  # every article that is indexed has a first chunk
        F.count_if(F.col("chunk_index") == 0).alias("indexed"), F.count(F.lit(1)).alias("new_chunks")
    ).first()
    inserted = tables.read_articles(spark, store.articles, write_id).count()
    return {**answers.asDict(), **indexed.asDict(), "new_inserted": inserted}


def ingest_counts(spark: SparkSession, store: Store, load_id: str) -> DataFrame:
    """Counters of a load: (counter, n).

    Answers landed and rejected, articles fetched, inserted and indexed, chunks, and chunks whose
    vector is zero, as the model failed or found no word.
    """
    ended = stores.commit_of(spark, store, load_id)
    counters = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in COUNTERS])
    writes = [r.write_id for r in ended.select("write_id").collect()]
    chunks = tables.read_chunks(spark, store.chunks, loads=writes)
    empty = F.count_if(F.forall("embedding", lambda x: x == 0))
    without = chunks.agg(empty.alias("n")).select(F.lit("without_vector").alias("counter"), "n")
    return ended.select(F.inline(counters)).unionByName(without)


def ingest_stream(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    vectoriser: Vectoriser | None = hashed_vectors,
    once: bool = False,
    files_per_batch: int | None = None,
    categories: Sequence[str] | None = None,
) -> StreamingQuery:
    """Keep the store at `root` up to date with a landing folder.

    Runs every 15 minutes, or with `once` until all that has landed is stored. Loads are named by
    checkpoint and batch, and a repeated batch adds nothing twice. `categories` keeps the answers
    to requests for those, e.g. `fixed.TIMER_CATEGORIES`.
    """
    store = stores.create(spark, root)
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def load(landed: DataFrame, batch: int) -> None:
        load_batch(landed, store, f"{stream}-{batch:012d}", vectoriser)

    reader = spark.readStream.schema(payloads.LANDED_SCHEMA).options(**payloads.READ_OPTIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    answers = reader.json(landing)
    if categories is not None:
        answers = answers.filter(F.col("requested_category").isin(*categories))
    trigger = (
        {"availableNow": True} if once
        else {"processingTime": f"{fixed.FETCH_INTERVAL_MINUTES} minutes"}
    )
    return (
        answers.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
