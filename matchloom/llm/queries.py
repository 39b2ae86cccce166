"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import decontaminate as dec
from . import exact_dedup as exact
from . import language_id as lid
from . import license_scan as license
from . import line_dedup as line
from . import near_dedup as near
from . import prefix_counts as prefix
from . import quality as quality_model
from . import sharding, trie, warc
from . import window_panes as panes
from ._util import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = written(quality_model.featurise(table(spark, sf_dir, "documents")), "quality-features")
    return quality_model.assess(featured, quality_model.train(featured))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line.line_dedup(table(spark, sf_dir, "documents"), min_docs=10)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True).drop("text")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lid.identify(docs.select("doc_id", "text"), lid.learn_from_kept_in(docs))
    return found.select("doc_id", lid.held_out().alias("held_out"), "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license.license_scan(docs).drop("text", "matches")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.rebuilt(trie.numbered_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sharding.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    text = F.coalesce("row.text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    placed = sharding.slots(stored, F.col("row.doc_id").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.revised_panes(panes.click_batches(table(spark, sf_dir, "clicks")))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe": op4_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_window_panes": op13_window_panes,
}

#: A-Z to a-z and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of single bytes, from its polynomial; DuckDB has no such function.
_POLYNOMIAL = 0xEDB88320


def _crc_of_byte(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (_POLYNOMIAL if c & 1 else 0)
    return c


_CRC_TABLE = "[" + ", ".join(f"{_crc_of_byte(i)}::BIGINT" for i in range(256)) + "]"


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text."""
    letters = f"list_transform(range(1, len({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({letters}, lambda c, x: xor(c >> 8, {_CRC_TABLE}[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_TURN_KEY = "substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)"
_HOUR_US, _DAY_US = 3_600_000_000, 86_400_000_000

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
    "op3_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, string_split({_LOWER}, chr(10)) AS low FROM documents),
        e AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line,
                     unnest(list_transform(low, lambda l: trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS k FROM d),
        hot AS (SELECT k FROM e WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        m AS (SELECT e.*, hot.k IS NOT NULL AS gone FROM e LEFT JOIN hot ON e.k = hot.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm""",
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN_KEY}) AS seq, {_TURN_KEY} AS k,
                          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (SELECT t.* FROM t JOIN c ON t.conv_id = c.conv_id WHERE seq > h
              UNION ALL SELECT c.conv_id, seq, k, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE seq <= h),
        w AS (SELECT c.conv_id, coalesce(string_agg(k, '' ORDER BY seq), '') AS name, list(words ORDER BY seq) AS words, count(k) AS n FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
        p AS (SELECT conv_id, n, name, words, unnest(range(n + 1)) AS depth FROM w),
        g AS (SELECT substr(name, 1, 32 * depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
        k AS (SELECT substr(node, 1, 32 * (depth - 1)) AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
        f AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k ON k.node = g.node),
        s AS (SELECT substr(node, 1, 32 * up) AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
              FROM (SELECT *, unnest(range(depth + 1)) AS up FROM f) GROUP BY 1)
        SELECT f.conv_id, f.depth, above.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
        FROM f JOIN s ON s.node = f.node LEFT JOIN g above ON f.depth > 0 AND above.node = substr(f.node, 1, 32 * (f.depth - 1))""",
    "op13_window_panes": f"""
        WITH one AS (SELECT *, epoch_us(coalesce(arrived_at, ts)) // {_DAY_US} AS day FROM clicks WHERE ts IS NOT NULL
                     QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, coalesce(arrived_at, ts), kind NULLS FIRST, value NULLS FIRST) = 1),
        r AS (SELECT click_id, least(11, day % 12 + CASE WHEN click_id IS NULL THEN 0 ELSE greatest(0, {_crc32("CAST(click_id AS VARCHAR)")} % 30 - 23) END) AS batch,
                     epoch_us(ts) - (day - day % 12) * {_DAY_US} AS event, coalesce(kind, 'none') AS kind, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents FROM one),
        h AS (SELECT *, CAST(floor(event / {_HOUR_US}.0) AS BIGINT) AS hour FROM r),
        w AS (SELECT b AS batch, (SELECT max(event) FROM r WHERE r.batch < b) AS w FROM range(12) t(b)),
        x AS (SELECT h.*, coalesce(w.w >= (hour + 1) * {_HOUR_US} + 3 * {_DAY_US}, false) AS late FROM h JOIN w ON w.batch = h.batch),
        a AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM x WHERE NOT late GROUP BY ALL),
        u AS (SELECT *, sum(n) OVER o AS n_upto, sum(c) OVER o AS c_upto, lead(batch) OVER o AS next_batch, min(batch) OVER (PARTITION BY kind, hour) AS first_batch,
                     (SELECT min(w.batch) FROM w WHERE w.w >= (a.hour + 3) * {_HOUR_US}) AS due FROM a WINDOW o AS (PARTITION BY kind, hour ORDER BY batch)),
        e AS (SELECT *, greatest(first_batch, due) AS emitted FROM u),
        o AS (SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM x WHERE late
              UNION ALL SELECT emitted, hour, -1, n_upto, c_upto, 'emit', kind FROM e WHERE due IS NOT NULL AND batch <= emitted AND (next_batch IS NULL OR next_batch > emitted)
              UNION ALL SELECT 11, hour, -1, n_upto, c_upto, 'final', kind FROM e WHERE due IS NULL AND next_batch IS NULL
              UNION ALL SELECT batch, hour, -1, n_upto - n, c_upto - c, 'retract', kind FROM e WHERE due IS NOT NULL AND batch > emitted
              UNION ALL SELECT batch, hour, -1, n_upto, c_upto, 'replace', kind FROM e WHERE due IS NOT NULL AND batch > emitted)
        SELECT CAST(batch AS BIGINT) AS batch, hour, coalesce(click_id, -1) AS click_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(cents AS BIGINT) AS cents, record, kind FROM o""",
}
