"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import fresh_path

# At most so many keys (two longs each, some tens of MB in memory) are broadcast; beyond it the
# same join shuffles both sides.
FEW_KEYS = 1_000_000


def documents(docs: DataFrame) -> DataFrame:
    """The two columns the operators read; whatever else a table has is left behind here."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): doc_id and text_key together name a version of a document.

    Rows that share a doc_id but not their text stay apart; rows equal in both are equal in
    everything an operator returns for them. A missing text has a key of its own.
    """
    return documents(docs).withColumn("text_key", F.xxhash64("text"))


def same_version(left: DataFrame, right: DataFrame):
    """Join condition on doc_id and text_key; missing ids match each other."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def free_names(rows: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that `rows` does not have, in whatever case."""
    taken = {c.lower() for c in rows.columns}
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [f"{mark}{name}" for name in names]


def quoted(name: str) -> str:
    """A column's name as it stands in expressions and schemas."""
    return "`" + name.replace("`", "``") + "`"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: it cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_few(keys: DataFrame, most: int = FEW_KEYS) -> DataFrame:
    """`keys` (narrow rows of fixed width) marked for broadcast if there are at most `most`."""
    return F.broadcast(keys) if keys.count() <= most else keys


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `most` bytes of text; a longer one is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(size.astype(np.int64)) // most
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a missing one is empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


_held: dict = {}


def of_worker(name: str, key, make: Callable):
    """What a worker process keeps from one task to the next: one thing, made when it is needed.

    Another operator's tasks in the same process let go of it, so that caches do not add up.
    """
    if _held.get("of") != (name, key):
        _held.clear()
        _held["value"] = make()
        _held["of"] = name, key
    return _held["value"]


class Remembered(dict):
    """A dict of about `most` entries: when it is full, only those used since the last time stay.

    `get_kept` finds an entry of either generation and keeps it.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = max(1, most // 2), {}

    def get_kept(self, key):
        """The value, or None."""
        found = self.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self[key] = found
        return found

    def make_room(self, more: int = 1) -> None:
        if len(self) + more > self.most:
            self.old = dict(self)
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [starts[i], starts[i] + lengths[i])."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(before - starts, lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
