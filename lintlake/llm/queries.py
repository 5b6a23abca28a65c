"""Registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.bpe import decode_documents, encode_documents
from lintlake.llm.common import stored, text_bytes
from lintlake.llm.conversations import damaged, repair_conversations
from lintlake.llm.decontaminate import contaminated_pairs
from lintlake.llm.fingerprints import edit_probe
from lintlake.llm.html import extract_pages
from lintlake.llm.jaccard_join import similar_documents
from lintlake.llm.lines import LineIndex
from lintlake.llm.negatives import hard_negatives, integer_vectors
from lintlake.llm.packing import pack_documents
from lintlake.llm.sharding import byte_shards
from lintlake.llm.token_rollup import TokenRollup, deletes, inserts, revisions, token_counts
from lintlake.llm.toxicity import held_out, learn, score_documents, training_labels
from lintlake.llm.warc import derivatives, responses_of_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_table_entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


# The register takes a byte by the table entries of its set bits, which is the entry of the whole.
CRC_STEP = "c >> 8"
for _bit in range(8):
    CRC_STEP = f"xor({CRC_STEP}, (xor(c, b) >> {_bit} & 1) * {_crc_table_entry(1 << _bit)})"
BYTES_SQL = "list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT))"


@query("op1_byte_shards", f"""WITH rows_ AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
      xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES_SQL}), lambda c, b: {CRC_STEP}), 4294967295) AS text_crc32 FROM documents),
    placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(size) OVER () AS total FROM rows_),
    sharded AS (SELECT *, CAST(least((2 * before + size) * 40 // greatest(2 * total, 1), 39) AS INTEGER) AS shard FROM placed)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM sharded""")
def byte_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_shards(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op8_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op2_line_dedup", """
    WITH lines AS (
      SELECT doc_id, nth, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents)),
    common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < keeper) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
    FROM lines LEFT JOIN common USING (key) GROUP BY doc_id""")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = LineIndex(spark).insert(docs).dedup(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(text_bytes(), 256).alias("kept_sha256"))


_SHINGLES = """
      SELECT DISTINCT {key}, array_to_string(list_slice(words, nth, nth + 4), ' ') AS shingle
      FROM (SELECT {key}, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) AS nth
            FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS words FROM {table}))"""


@query("op3_decontamination", f"""
    WITH d AS ({_SHINGLES.format(key="doc_id", table="documents")}), i AS ({_SHINGLES.format(key="item_id", table="benchmark")}),
    n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
    SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
    FROM d JOIN i USING (shingle) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles""")
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))


@query("op5_token_rollup")
def token_rollup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: provisional counts (a token per four bytes), their revision by two tokenizers, the
    withdrawal of low-quality documents, and the revision once more, which changes nothing."""
    counts = stored(token_counts(table(spark, sf_dir, "documents"), ("byte_bpe_50k", "byte_bpe_multi_50k")).withColumn(
        "was", F.expr("n_bytes div 4")), "token-counts")
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    rollup = TokenRollup(spark)
    rollup.commit("first", inserts(counts.withColumn("tokens", F.col("was"))))
    rollup.commit("revised", revisions(counts))
    rollup.commit("withdrawn", deletes(counts.join(low, "doc_id", "left_semi")))
    rollup.commit("revised", revisions(counts))
    return rollup.totals()


@query("op6_warc_derivatives")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses_of_pages(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))


@query("op7_main_text")
def main_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "passages")


@query("op10_jaccard_join")
def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def _plus(cell: str, cost: str, letters: str) -> str:
    return f"(lpad((substr({cell}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({cell}, 13) || {letters})"


def _row_step(state: str, into: str, role: str) -> str:
    """A row that is deleted, or that leads from one of some states into another; cells are strings of cost and audit."""
    ways = [_plus(f"k{n}", f"cut + CASE WHEN initial = '{role}' THEN 0 ELSE 1 END", f"CASE WHEN initial = '{role}' THEN 'K' ELSE 'R' END") for n in into]
    return f"least({_plus(f'k{state}', '2', chr(39) + 'D' + chr(39))}, CASE WHEN fault IN ('k', 't') THEN least({', '.join([*ways, 'NULL'])}) END)"


_SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_CLOSED = f"""least(c2, {_plus('c0', '5', "'I'")}, {_plus('c1', '5', "'I'")}, {_plus('c3', '5', "'I'")}) AS k2,
           least(c3, {_plus('c2', '5', "'I'")}, {_plus('c0', '10', "'II'")}, {_plus('c1', '10', "'II'")}) AS k3"""


@query("op11_conversation_repair", f"""
    WITH RECURSIVE hashed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                 string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''),
                 lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
             4294967295) % 20 AS kind FROM conversations),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(generate_series(1, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM hashed WHERE kind <> 0),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
             rtrim(text, {_SPACES}) AS solid FROM damaged),
    rows AS (
      SELECT *, CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                     WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
             substr(role, 1, 1) AS initial FROM numbered),
    steps AS (SELECT *, CASE fault WHEN 't' THEN 5 ELSE 0 END AS cut FROM rows),
    walk AS (
      SELECT conv_id, 0::BIGINT AS pos, repeat('0', 12) AS c0, NULL::VARCHAR AS c1, NULL::VARCHAR AS c2, NULL::VARCHAR AS c3
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, pos, {_plus('k0', '2', "'D'")},
             least({_plus('k1', '2', "'D'")}, CASE WHEN initial = 's' AND fault IN ('k', 't') THEN {_plus('k0', 'cut', "'K'")} END),
             {_row_step('2', '013', 'u')}, {_row_step('3', '2', 'a')}
      FROM (SELECT s.conv_id, s.pos, s.initial, s.fault, s.cut, w.c0 AS k0, w.c1 AS k1, {_CLOSED}
            FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1)),
    best AS (
      SELECT conv_id, least(c0, k3) AS best FROM (SELECT conv_id, c0, {_CLOSED} FROM walk
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)),
    letters AS (
      SELECT conv_id, audit, j, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS nth
      FROM (SELECT conv_id, audit, j, substr(audit, j, 1) AS letter
            FROM (SELECT conv_id, substr(best, 13) AS audit, unnest(generate_series(1, length(best) - 12)) AS j FROM best))
      WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
    placed AS (
      SELECT l.conv_id, l.j, l.letter, l.nth, s.role, s.text,
             max(CASE WHEN l.nth = 1 AND l.letter = 'K' AND s.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
      FROM letters l LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.pos = l.pos AND l.letter <> 'I' WHERE l.letter <> 'D'),
    texts AS (
      SELECT conv_id, string_agg(concat(CASE WHEN letter = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END,
                                        ':', CASE letter WHEN 'I' THEN '' ELSE text END), chr(10) ORDER BY j) AS text
      FROM placed GROUP BY conv_id),
    faults AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
             count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
             count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM steps) GROUP BY conv_id)
    SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
           coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, substr(best, 1, 12)::BIGINT AS cost,
           substr(best, 13) AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
    FROM best b LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id""")
def conversation_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


@query("op12_hard_negatives", """
    WITH v AS (
      SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row),
    p AS (
      SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS nth
      FROM s WHERE same QUALIFY nth <= 5)
    SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.row, nth ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.row = p.row AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3""")
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(integer_vectors(rows), F.expr("vec_id % 50 = 0"))


@query("op13_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_documents(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.array_join("ids", ","), "UTF-8"), 256).alias("ids_sha256"),
                       F.sha2(text_bytes("decoded"), 256).alias("decoded_sha256"))
