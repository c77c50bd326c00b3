"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmlens.functions import repair, text
from swarmlens.sources import model

SPACE = r"[\s\u0085   -     　]"


def _cut_json(s, d):
    """Event properties, every second one cut off inside."""
    rows = model.table(s, d, "events")
    return rows.select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Result: "), "props")).otherwise(F.concat(F.lit('{"a": ["x", {"p": '), "props", F.lit(', "q": "cut'))).alias("raw"))


CHUNKS_SQL = """WITH RECURSIVE c AS (
          SELECT doc_id, text, CAST(0 AS BIGINT) AS pos, CASE WHEN length(text) <= 500 THEN length(text) ELSE CAST(NULL AS BIGINT) END AS stop, 0 AS k FROM documents
          UNION ALL
          SELECT doc_id, text, CASE WHEN stop IS NULL THEN pos ELSE stop - 50 END, CASE WHEN stop IS NULL THEN
            CASE WHEN pos + 500 >= length(text) THEN length(text) ELSE (
              SELECT coalesce(min_by(pos + p + n, o), pos + 500) FROM (
                SELECT o, length(m) AS n, CASE WHEN contains(substr(text, pos + 1, 500), m) THEN 500 - least(500, length(substr(text, pos + 1, 500))) + length(substr(text, pos + 1, 500)) - (strpos(reverse(substr(text, pos + 1, 500)), reverse(m)) - 1) - length(m) ELSE -1 END AS p
                FROM (VALUES (1, '。'), (2, '！'), (3, '？'), (4, '.' || chr(10)), (5, '!' || chr(10)), (6, '?' || chr(10)), (7, chr(10) || chr(10)), (8, '. '), (9, '! '), (10, '? ')) AS v(o, m)) WHERE p > 150) END
            ELSE NULL END, CASE WHEN stop IS NULL THEN k ELSE k + 1 END
          FROM c WHERE stop IS NULL OR stop < length(text)
        ), pieces AS (SELECT doc_id, k, regexp_replace(substr(text, pos + 1, stop - pos), '^\\s+|\\s+$', '', 'g') AS chunk FROM c WHERE stop IS NOT NULL)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS k, md5(chunk) AS digest, CAST(length(chunk) AS INTEGER) AS n_chars FROM pieces WHERE chunk <> ''"""
CHUNK_BATCHES_SQL = f"SELECT n, count(*) AS batches FROM (SELECT doc_id, k // 3, count(*) AS n FROM ({CHUNKS_SQL}) GROUP BY ALL) GROUP BY n"

QUERIES = {
    "text_stats": (
        lambda s, d: model.table(s, d, "documents").select("doc_id", *text.stats("text")),
        """SELECT doc_id, CAST(length(text) AS INTEGER) AS total_chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS total_lines,
        CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS total_words FROM documents""",
    ),
    "normalized_text": (
        lambda s, d: model.table(s, d, "documents").select("doc_id", F.md5(text.normalized(F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".\r\n\r\n\n \n"))))).alias("digest")),
        """SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace('  ' || replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || ' ' || chr(10)), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)),
        lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), chr(10)), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents""",
    ),
    "chunks": (
        lambda s, d: text.chunks(model.table(s, d, "documents")).select("doc_id", "k", F.md5("chunk").alias("digest"), F.length("chunk").alias("n_chars")),
        CHUNKS_SQL,
    ),
    "chunk_batches": (
        lambda s, d: text.chunks(model.table(s, d, "documents")).groupBy("doc_id", F.floor(F.col("k") / 3).alias("batch")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("batches")),
        CHUNK_BATCHES_SQL,
    ),
    "usernames": (
        lambda s, d: model.table(s, d, "part").select("p_partkey", text.username(F.concat_ws(" ", "p_name", "p_brand")).alias("username")),
        """SELECT p_partkey, regexp_replace(replace(lower(p_name || ' ' || p_brand), ' ', '_'), '[^\\p{L}\\p{N}_]', '', 'g') || '_' ||
        (100 + CAST(('0x' || substr(md5(p_name || ' ' || p_brand), 1, 8)) AS BIGINT) % 900) AS username FROM part""",
    ),
    "key_quotes": (
        lambda s, d: model.table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(text.key_quotes(F.col("text")), "|").alias("quotes")),
        """WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 150 AND NOT regexp_matches(x, '^[\\p{P}\\s]')) AS good FROM conversations WHERE role = 'assistant')
        SELECT conv_id, turn, array_to_string(list_transform(list_slice(list_sort(list_transform(good, lambda x, i: {'n': -length(x), 'i': i, 's': x})), 1, 3), lambda x: x.s), '|') AS quotes FROM s""",
    ),
    "truncated_summaries": (
        lambda s, d: model.table(s, d, "documents").select("doc_id", F.md5(text.cut(F.col("text"), 100)).alias("digest")),
        "SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END) AS digest FROM documents",
    ),
    "interview_prompts": (
        lambda s, d: model.table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(text.interview_prompt(text.interview_prompt(F.col("text"), "Answer as yourself: "), "Answer as yourself: ")).alias("digest")),
        "SELECT conv_id, turn, md5('Answer as yourself: ' || text) AS digest FROM conversations WHERE role = 'user'",
    ),
    "class_names": (
        lambda s, d: model.table(s, d, "part").select("p_partkey", text.pascal(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name")),
        "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '') AS name FROM part",
    ),
    "guarded_attributes": (
        lambda s, d: model.table(s, d, "part").select("p_partkey", text.guarded_attribute(F.when(F.col("p_size") % 2 == 0, "Summary").otherwise(F.col("p_type"))).alias("attribute")),
        "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'entity_Summary' ELSE p_type END AS attribute FROM part",
    ),
    "file_kinds": (
        lambda s, d: model.table(s, d, "pages").select("page_id", text.file_kind(F.concat("url", F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(".md"))).alias("kind"), text.allowed_file(F.concat("url", F.lit(".exe"))).alias("allowed")),
        "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'markdown' END AS kind, false AS allowed FROM pages",
    ),
    "json_repair": (lambda s, d: _cut_json(s, d).select("event_id", repair.repaired_json(F.col("raw")).alias("json")), None),
    "json_props": (
        lambda s, d: model.table(s, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))).alias("k")),
        "SELECT event_type, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k FROM events GROUP BY event_type",
    ),
    "section_clean": (
        lambda s, d: model.table(s, d, "documents").select("doc_id", F.md5(repair.cleaned_section(F.concat(F.lit("# T\n\n---\n## Part\n"), "text"), F.lit("T"))).alias("digest")),
        None,
    ),
    "benchmark_words": (
        lambda s, d: model.table(s, d, "benchmark").select("item_id", F.size(F.split("text", r"(?U)\s+")).alias("words"), F.left("text", F.lit(20)).alias("title")),
        "SELECT item_id, CAST(len(regexp_split_to_array(text, '\\s+')) AS INTEGER) AS words, left(text, 20) AS title FROM benchmark",
    ),
}
