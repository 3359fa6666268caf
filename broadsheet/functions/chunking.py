"""Overlapping, sentence-aware chunks of a text, as column expressions.

A chunk is a window of `size` characters, cut after its last full stop or newline if that lies
beyond 30 % of the window; the next window starts `overlap` characters before the cut. The parts
that each window adds (the "tiles") do not overlap and follow one another without gaps, so one
regular expression cuts a text into its tiles in a single pass, and a chunk is its tile preceded
by the last `overlap` characters of the tile before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed


def _tile_pattern(size: int, overlap: int) -> str:
    earliest = math.floor(size * fixed.BREAK_AFTER) + 1  # first index a cut may follow

    def tile(window: int, least: int) -> str:
        cut = rf".{{{least},{window - 1}}}[.\n]"
        return rf"(?=.{{{window + 1}}})(?:{cut}|.{{{window}}})|.{{1,{window}}}"

    first = tile(size, earliest)
    later = tile(size - overlap, earliest - overlap)
    return rf"(?s)\A(?:{first})|{later}"


def tiles(text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """The parts of `text` that its windows add one after the other."""
    earliest = math.floor(size * fixed.BREAK_AFTER) + 1
    if not 0 < overlap or 2 * overlap > earliest + 1:
        raise ValueError(f"overlap must be positive and at most {(earliest + 1) // 2}")
    return F.regexp_extract_all(text, F.lit(_tile_pattern(size, overlap)), F.lit(0))


def with_chunks(
    df: DataFrame,
    text: Column,
    into: str = "chunks",
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
) -> DataFrame:
    """Add the list of chunks of `text`.

    The steps are separate projections because each one uses the one before several times.
    """
    stripped = F.lit(fixed.STRIPPED)
    full = F.lit(size - overlap)

    def window(tile: Column, i: Column) -> Column:
        before = F.right(F.get(F.col("_tiles"), i - 1), F.lit(overlap))
        return F.when(i == 0, tile).otherwise(F.concat(before, tile))

    # A last window longer than size - overlap is followed by one more, of its remainder.
    last = F.element_at(F.col("_windows"), -1)
    remainder = F.when(
        F.length(last) > full, F.array(F.substr(last, full + 1))
    ).otherwise(F.array().cast("array<string>"))
    kept = F.filter(
        F.transform(F.concat(F.col("_windows"), remainder), lambda w: F.btrim(w, stripped)),
        lambda w: w != "",
    )
    short = F.length("_text") < fixed.SHORT_TEXT
    return (
        df.withColumn("_text", F.coalesce(text, F.lit("")))
        .withColumn("_tiles", F.when(~short, tiles(F.col("_text"), size, overlap)))
        .withColumn("_windows", F.transform("_tiles", window))
        .withColumn(
            into,
            F.when(F.col("_text") == "", F.array().cast("array<string>"))
            .when(short, F.array("_text"))
            .otherwise(kept),
        )
        .drop("_text", "_tiles", "_windows")
    )


def chunk_id(article_id: Column | str, index: Column | str) -> Column:
    return F.concat_ws("_chunk_", article_id, F.col(index) if isinstance(index, str) else index)
