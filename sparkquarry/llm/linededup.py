"""Line dedup by overlapping three-line windows, in SQL functions only.

A document's lines that are not blank, trimmed, form windows of three consecutive lines, each hashed to 128 bits; one or
two consecutive lines of 50 words or more together are windows as well, so that a long passage on one line is found
between other neighbours.  A window that occurs again anywhere is kept where it comes first (by doc_id, then place); the
lines under all later occurrences are covered, and overlapping windows merge into longer covered runs.  Covered lines,
with blank lines inside a run, are removed; all others stay as they were.

Windows are exploded once into a written table; the first place of each is a grouped minimum with partial sums, and the
join back is a plain equi-join, whose hot keys adaptive execution splits.

Defined results: null texts stay null; texts of one or two short lines are never changed; a document whose lines are all
covered gets an empty text; rows that share doc_id and text count as one document and are treated alike; a null doc_id
comes first; an empty table stays empty; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, WORD, columns_of, written

#: Lines of a window; words from which fewer lines are a window too.
LINES, LONG = 3, 50

_TRIM = "trim(BOTH '\\t\\u000b\\f\\r ' FROM {0})"


def _lined(docs: DataFrame) -> DataFrame:
    """Add lines (array), and seen: place and trimmed text of those that are not blank."""
    d = docs.withColumn("lines", F.split("text", "\n", -1)).withColumn("_text", F.xxhash64("text"))
    return d.withColumn("seen", F.expr(f"filter(transform(lines, (x, i) -> struct(i, {_TRIM.format('x')} AS x)), s -> s.x <> '')"))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, and for each window its first and last line and its hash."""
    d = _lined(columns_of(docs, "doc_id", "text")).where("size(seen) > 0")
    d = d.withColumn("words", F.transform("seen", lambda s: F.regexp_count(s["x"], F.lit(WORD))))
    made = []
    for n in range(1, LINES + 1):
        text = ", ".join(f"seen[k + {i}].x" for i in range(n))
        enough = "true" if n == LINES else " + ".join(f"words[k + {i}]" for i in range(n)) + f" >= {LONG}"
        made.append(
            f"if(size(seen) < {n}, array(), transform(filter(sequence(0, size(seen) - {n}), k -> {enough}), "
            f"k -> struct(seen[k].i AS a, seen[k + {n - 1}].i AS b, xxhash64({n}, {text}) AS h1, xxhash64('window', {n}, {text}) AS h2)))"
        )
    return d.select("doc_id", "_text", F.explode(F.expr(f"concat({', '.join(made)})")).alias("w")).select("doc_id", "_text", "w.*")


def dedup(docs: DataFrame) -> DataFrame:
    """The columns of documents, and n_lines and removed_lines; text and n_chars without the covered lines."""
    occ = written(occurrences(docs))
    place = F.struct("doc_id", "_text", "a")
    first = occ.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = occ.join(first, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(~place.eqNullSafe(F.col("_first")))
    covered = later.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    # texts cross the shuffle, their lines are split after it
    d = columns_of(docs, *DOC_COLUMNS).withColumn("_key", F.xxhash64("text"))
    d = _lined(d.join(covered, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left"))
    kept = F.expr("array_except(sequence(0, size(lines) - 1), flatten(transform(runs, r -> sequence(r.a, r.b))))")
    d = d.withColumn("kept", F.when(F.col("runs").isNotNull(), kept))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    return d.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"), F.greatest(n, F.lit(0)).alias("n_lines"), F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept")).alias("removed_lines"))


_SQL_TRIM = "trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' ')"
SQL = rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, {_SQL_TRIM} AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), s AS (
  SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
    lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2, lead(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')), 1) OVER o AS w1
  FROM l WHERE x <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), v AS (
  SELECT doc_id, i AS a, i AS b, '1' || chr(10) || x AS k FROM s WHERE w >= {LONG}
  UNION ALL SELECT doc_id, i, i1, '2' || chr(10) || x || chr(10) || x1 FROM s WHERE x1 IS NOT NULL AND w + w1 >= {LONG}
  UNION ALL SELECT doc_id, i, i2, '3' || chr(10) || x || chr(10) || x1 || chr(10) || x2 FROM s WHERE x2 IS NOT NULL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS nth FROM v
), c AS (
  SELECT DISTINCT l.doc_id, l.i FROM l JOIN r ON l.doc_id = r.doc_id AND l.i BETWEEN r.a AND r.b WHERE r.nth > 1
), g AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS removed FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
), t AS (
  SELECT l.doc_id, string_agg(y, chr(10) ORDER BY l.i) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS y, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) l
  LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i WHERE c.i IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN g.removed > 0 THEN coalesce(t.text, '') ELSE d.text END AS text, d.lang, d.source,
  (CASE WHEN g.removed > 0 THEN length(coalesce(t.text, '')) ELSE d.n_chars END)::BIGINT AS n_chars,
  coalesce(g.n_lines, 0)::INTEGER AS n_lines, coalesce(g.removed, 0)::INTEGER AS removed_lines
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
