"""One query per operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import (
    ann,
    fim,
    fingerprints,
    langid,
    line_dedup,
    manifest,
    merkle,
    mixture,
    ngram_join,
    packing,
    secrets,
    suffix_dedup,
    transducer,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_fingerprints(spark, sf):
    return fingerprints.fingerprint_edits(_table(spark, sf, "documents"))


@query
def op4_secrets(spark, sf):
    return secrets.scan(_table(spark, sf, "documents"))


@query
def op5_packing(spark, sf):
    return packing.pack(_table(spark, sf, "documents"), WORD_BPE)


@query
def op6_ann(spark, sf):
    rows = _table(spark, sf, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query
def op8_langid(spark, sf):
    return langid.predict_all(_table(spark, sf, "documents"))


@query
def op3_ngram_join(spark, sf):
    found = ngram_join.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op10_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(_table(spark, sf, "documents"))


@query
def op1_line_dedup(spark, sf):
    return line_dedup.summary(_table(spark, sf, "documents"))


@query
def op7_merkle(spark, sf):
    return merkle.audit_copy(_table(spark, sf, "pages"))


ORACLES["op7_merkle"] = r"""
WITH n AS (SELECT greatest(1, (count(*) + 511) // 512) AS shards FROM pages),
r AS (
  SELECT page_id,
    CAST('0x' || substr(md5(coalesce(url, '') || ':' || CAST(coalesce(page_id, -1) AS VARCHAR)), 1, 8) AS BIGINT)
      % shards AS shard,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:sha256:' || sha256(coalesce(url, '')) || '>' || chr(13) || chr(10)
      || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10)
      || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages, n
),
p AS (
  SELECT *, CAST(row_number() OVER o - 1 AS BIGINT) AS seq,
    CAST(sum(strlen(record)) OVER o AS BIGINT) - strlen(record) AS start
  FROM r WINDOW o AS (PARTITION BY shard ORDER BY page_id ROWS UNBOUNDED PRECEDING)
),
d AS (
  SELECT *, CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 101 = 7 THEN 'altered' ELSE 'ok' END AS state,
    encode(record) AS bytes
  FROM p
)
SELECT page_id, shard, seq, start, strlen(record) AS length, sha256(bytes) AS sha256,
  CASE state WHEN 'ok' THEN sha256(bytes)
    WHEN 'altered' THEN sha256(from_hex(
      substr(hex(bytes), 1, 2 * (strlen(record) // 2)) || '00' || substr(hex(bytes), 2 * (strlen(record) // 2) + 3)
    )) END AS replica_sha256, state
FROM d
"""


@query
def op9_sentencepiece(spark, sf):
    return transducer.round_trip(_table(spark, sf, "documents"), PIECE_BPE)


@query
def op11_fim(spark, sf):
    return fim.round_trip(_table(spark, sf, "documents"))


ORACLES["op11_fim"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
c AS (
  SELECT *, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS x,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
p AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS prefix,
    array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(units[greatest(x, y) + 1:n], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query
def op12_manifest(spark, sf):
    return manifest.verified_documents(_table(spark, sf, "documents"))


def _manifest_sql(levels: int = 7, top_levels: int = 3) -> str:
    """SQL of the manifest for up to 8 ** levels documents per language and 8 ** top_levels languages.

    Of a level that a tree does not have, the one node is left as it is.
    """
    def digest(text: str) -> str:
        values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return "sha256(" + " || ".join(
            f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{capitals}', '{capitals.lower()}')"
    # The checksum of the id's digits: each is put into the register, which is then shifted 8 times.
    steps = """flatten(list_transform(range(1, length(id) + 1),
      lambda i: [CAST(ascii(substr(id, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"""
    register = f"""list_reduce(list_concat([4294967295], {steps}),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"""
    ctes = [f"""l AS (
  SELECT doc_id, coalesce('+' || lang, '') AS grp, {digest("text")} AS leaf,
    CASE WHEN xor({register}, 4294967295) % 3 = 0 THEN {digest(lowered)} ELSE {digest("text")} END AS presented,
    CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS place
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents)
)""", "a0 AS (SELECT grp, place, leaf AS d FROM l)"]

    def tree(name: str, height: int) -> None:
        """Per level the runs, as the text of their digests, and the nodes above them."""
        for k in range(height):
            ctes.append(
                f"{name}r{k} AS (SELECT grp, place // 8 AS run, string_agg(d, '' ORDER BY place) AS t,"
                f" sum(count(*)) OVER (PARTITION BY grp) AS n FROM {name}{k} GROUP BY grp, place // 8)")
            ctes.append(
                f"{name}{k + 1} AS (SELECT grp, run AS place, CASE WHEN n > 1 THEN sha256(t) ELSE t END AS d"
                f" FROM {name}r{k})")

    def climb(name: str, height: int, before: str) -> str:
        """Proofs and folded nodes of all leaves, level by level up a tree."""
        for k in range(height):
            side = f"""substr(t, 1, 64 * (q.pos % 8))"""
            other = f"""substr(t, 64 * (q.pos % 8) + 65)"""
            ctes.append(f"""{name}q{k} AS (
  SELECT q.* EXCLUDE (proof, fold, pos), q.pos // 8 AS pos,
    CASE WHEN n > 1 THEN proof || {side} || {other} ELSE proof END AS proof,
    CASE WHEN n > 1 THEN sha256({side} || fold || {other}) ELSE fold END AS fold
  FROM {before} q JOIN {name}r{k} r ON r.grp = q.grp AND r.run = q.pos // 8
)""")
            before = f"{name}q{k}"
        return before

    tree("a", levels)
    ctes.append(f"s AS (SELECT grp, d, CAST(row_number() OVER (ORDER BY grp) - 1 AS BIGINT) AS place FROM a{levels})")
    ctes.append("b0 AS (SELECT '' AS grp, place, d FROM s)")
    tree("b", top_levels)
    ctes.append("q AS (SELECT doc_id, leaf, presented, grp, place AS pos, '' AS proof, presented AS fold FROM l)")
    inner = climb("a", levels, "q")
    ctes.append(f"""u AS (
  SELECT doc_id, leaf, s.d AS subroot, '' AS grp, s.place AS pos, proof, fold FROM {inner} q JOIN s ON s.grp = q.grp
)""")
    outer = climb("b", top_levels, "u")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, b{top_levels}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = b{top_levels}.d AS verified
FROM {outer} CROSS JOIN b{top_levels}
"""


ORACLES["op12_manifest"] = _manifest_sql()


@query
def op13_mixture(spark, sf):
    return mixture.mix(_table(spark, sf, "documents"))
