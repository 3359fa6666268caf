"""Session for tests and bench, the shared folder, and the size check before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", name: str = "broadsheet") -> SparkSession:
    """A local session; on a cluster the submitter builds the session instead."""
    parallel = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only on a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="broadsheet-"))
    return named or context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder, so that it is computed once for several uses."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_packed(df: DataFrame) -> DataFrame:
    """As `settle`, in less of the disk: columns are packed by batch, instead of rows by the session's codec.

    Partitions and the order of rows stay. For columns that Arrow has types for.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                stream.write_batch(batch)
            blob = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([blob], names=["blob"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column("blob"):
                with pa.ipc.open_stream(blob.as_buffer()) as stream:
                    yield from stream

    return settle(df.mapInArrow(pack, "blob binary")).mapInArrow(unpack, df.schema)


FEW_ROWS = 500_000  # narrow rows, such as ids, that are broadcast: some tens of MB


def broadcast_if_few(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows, else as it is, for a shuffle join.

    For narrow rows, such as ids; the default is FEW_ROWS.
    """
    return F.broadcast(df) if df.count() <= (FEW_ROWS if most is None else most) else df
