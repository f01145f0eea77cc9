"""Quality rules from the frequency of lines across documents, in DataFrame functions only.

Lines are normalised (lower case, digits to 0, white space to single spaces) and hashed.  Per host, the distinct
documents that hold a line are counted, exact copies of a text once.  A line in more than MAX_DOCS documents of its
host is boilerplate everywhere but in the first document (by id) that has it.  A document is depleted, and rejected, if
boilerplate holds more than MAX_REMOVED percent of its words; so of a large group of copies the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clears_tables, fresh, materialise, small_side

MAX_DOCS = 100
MAX_REMOVED = 70
WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(windows: Column) -> Column:
    """Words under windows (hashes by start) whose hash occurs twice or more."""

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts, zero, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("bigint").alias("n"), (p + WINDOW).alias("end"))
        )["n"]

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(F.array_sort(pairs), of_sorted))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row, without a shuffle: doc_id, host, fp (hash of the text), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, and lines array<struct<h, w, pos>> with hash, words and number of each line that has a word.

    Null texts have no words or lines; a null host is a host of its own.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", "host", "text", F.filter(F.split("text", WHITE), lambda w: w != "").alias("words"), F.split("text", "\n").alias("split"))
    d = d.withColumn("raw", F.filter("split", lambda x: F.translate(x, SPACES, "") != ""))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    n = F.size("words")
    windows = F.when(
        n >= WINDOW,
        let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))),
    ).otherwise(F.array().cast("array<bigint>"))
    normal = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), WHITE, " "))
    line = lambda x, i: let(normal(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.when(y == "", 0).otherwise(F.length(y) - F.length(F.translate(y, " ", "")) + 1).alias("w"), i.alias("pos")))
    return d.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("fp"),
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint").alias("n_dup_lines"),
        let(windows, covered).alias("n_repeat_words"),
        F.filter(F.transform("split", line), lambda x: x["w"] > 0).alias("lines"),
    )


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, h, first_id of lines in more than so many distinct documents of a host; two steps of partial counts."""
    once = lines.groupBy("host", "h", "fp").agg(F.min("doc_id").alias("first_id"))
    return once.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("first_id").alias("first_id")).where(F.col("n") > max_docs).drop("n")


def boilerplate(docs: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """What measures() gives, written, and doc_id, fp, pos, w of each line over the limit, but not of its first document."""
    table = materialise(measures(docs), "line-measures")
    lines = table.select("doc_id", "host", "fp", F.explode("lines").alias("x")).select("doc_id", "host", "fp", "x.pos", "x.h", "x.w")
    frequent = materialise(frequent_lines(lines, max_docs), "frequent-lines").withColumnsRenamed({"host": "f_host", "h": "f_h"})
    hit = lines.join(small_side(frequent), F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h")))
    hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    return table, hit.groupBy("doc_id", "fp", "pos").agg(F.max("w").alias("w"))  # rows alike in id and text are one


def verdict(table: DataFrame, removed: DataFrame, max_removed: int) -> DataFrame:
    """judge() by its tables; removed has doc_id, fp and removed_words."""
    removed = removed.withColumnsRenamed({"doc_id": "r_id", "fp": "r_fp"})
    out = table.drop("lines", "host").join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("fp") == F.col("r_fp")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("removed_words") <= max_removed * F.col("n_words")))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_removed: int = MAX_REMOVED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words and fp.

    One row per row of docs.  Base rules fail documents of fewer than 10 words and those with more than 20 % of
    their words in repeated 5-word windows.  Repeated rows are measured alike; an empty table gives no rows.
    """
    table, hit = boilerplate(docs, max_docs)
    out = verdict(table, hit.groupBy("doc_id", "fp").agg(F.sum("w").alias("removed_words")), max_removed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "fp")


@clears_tables
def changes(docs: DataFrame, max_docs: int, max_removed: int) -> DataFrame:
    """doc_id, fp, cut, gone of the documents that keep() rejects (gone) or cuts lines from (their positions)."""
    table, hit = boilerplate(docs, max_docs)
    removed = materialise(hit.groupBy("doc_id", "fp").agg(F.sum("w").alias("removed_words"), F.collect_set("pos").alias("cut")), "removed-lines")
    changed = verdict(table, removed, max_removed).where(~F.col("kept") | F.col("cut").isNotNull())
    return changed.groupBy("doc_id", "fp").agg(F.first("cut").alias("cut"), F.bool_or(~F.col("kept")).alias("gone"))


def keep(docs: DataFrame, max_docs: int = MAX_DOCS, max_removed: int = MAX_REMOVED) -> DataFrame:
    """docs without the rows that judge() rejects and without the lines over the limit; columns stay as they are.

    A text that loses no line stays as it is, null texts included; of others the remaining lines are joined by \\n.
    """
    ids, fps, cut, gone, mark = names = fresh(docs.columns, "judged_id", "judged_fp", "cut", "gone", "mark")
    changed = changes(docs, max_docs, max_removed).toDF(*names[:4])
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = marked.join(small_side(changed), F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col(mark) == F.col(fps)), "left")
    out = out.where(F.col(gone).isNull() | ~F.col(gone))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(cut, i)), "\n")
    return out.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW})
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, t, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, host, t, unnest(raw) AS x FROM d)
), frequent AS (
  SELECT host, line, min(doc_id) AS first_id FROM lines GROUP BY host, line HAVING count(DISTINCT t) > {MAX_DOCS}
), removed AS (
  SELECT doc_id, sum(len(line) - len(replace(line, ' ', '')) + 1) AS w FROM lines JOIN frequent USING (host, line) WHERE doc_id <> first_id GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.w, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * removed_words <= {MAX_REMOVED} * n_words AS kept,
  removed_words
FROM m
"""
