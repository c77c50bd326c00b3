"""Fill-in-middle transformation (13) by escaped marker injection, with Spark expressions only.

A text's units are ``[A-Za-z]+|[^A-Za-z]``, left to right over code points.
After every unit a delimiter is injected, so that units are counted and cut
out by rank with string functions and no array of units is ever made:

1.  The delimiter U+0001 and the escape U+0002 of the text are escaped as
    U+0002 U+0003 and U+0002 U+0004.  An escape is never followed by anything
    else, so both are taken back by plain replacement, in this order.
2.  One ``regexp_replace`` puts the delimiter after each unit; an escaped
    character counts as the one unit it stands for.
3.  The number of delimiters is the number of units; ``substring_index`` cuts
    the first, the ones between and the last.
4.  Delimiters go, escapes are taken back, and the parts are put in order.

No part can hold a marker that the text doesn't, and no marker can begin
within another, so an output is read back by ``substring_index`` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
DELIMITER, ESCAPE = "\u0001", "\u0002"
_ESCAPED = {DELIMITER: ESCAPE + "\u0003", ESCAPE: ESCAPE + "\u0004"}
_UNIT = f"([A-Za-z]+|{ESCAPE}.|[^A-Za-z])"
PLAIN_FROM, SPM_BELOW = 90, 20  #: percent of texts left plain from here on, of the others in the order suffix, prefix, middle


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def marked(text: Column) -> Column:
    """``text`` escaped and with a delimiter after every unit."""
    for old in (ESCAPE, DELIMITER):
        text = _replaced(text, old, _ESCAPED[old])
    return F.regexp_replace(text, _UNIT, f"$1{DELIMITER}")


def unmarked(text: Column) -> Column:
    text = _replaced(text, DELIMITER, "")
    for old in (DELIMITER, ESCAPE):
        text = _replaced(text, _ESCAPED[old], old)
    return text


def _cut(text: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(DELIMITER), count.cast("int"))


def transformed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) per row of ``docs`` (doc_id, text).

    Null texts are empty and stay plain, as texts that hold a marker do; a null
    doc_id draws as the empty string; repeated rows draw alike and stay; an
    empty table gives no rows; other columns are not looked at.  A row is
    handled by itself, so its text and a few copies of it have to fit a task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.select("doc_id", "text", marked(F.col("text")).alias("marked"), digest.alias("digest"))
    drawn = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    counted = rows.select("doc_id", "text", "marked", (F.length("marked") - F.length(_replaced(F.col("marked"), DELIMITER, ""))).cast("long").alias("n"), *drawn)
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = F.expr(" or ".join(["text = ''", f"h3 % 100 >= {PLAIN_FROM}", *(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))]))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    placed = counted.select("doc_id", "text", "marked", "n", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))
    # the marked text ends with a delimiter, so it has n + 1 parts, the last one empty
    a, b, whole, cut = F.col("a"), F.col("b"), F.col("marked"), F.col("form") != "plain"
    parts = placed.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(cut, unmarked(_cut(whole, a))).alias("prefix"),
        F.when(cut, unmarked(_cut(_cut(whole, b), a - b))).alias("middle"),
        F.when(cut, unmarked(_cut(whole, b - F.col("n") - 1))).alias("suffix"),
    )
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
        .otherwise(F.col("text"))
    )
    return parts.select("doc_id", "text", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output`` in ``form``."""
    body, last = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    after = lambda mark: F.substring_index(body, mark, -1)
    between = lambda first, then: F.substring_index(F.substring_index(body, then, 1), first, -1)
    psm = F.concat(between(PREFIX, SUFFIX), last, after(SUFFIX))
    spm = F.concat(after(PREFIX), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per document."""
    rows = transformed(docs)
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH rows AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM rows
), placed AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
