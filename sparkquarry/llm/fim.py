"""Fill-in-middle: texts cut into prefix, middle and suffix at units, as relations.

A unit is a word with the white space before it, or white space at the end.  Each text's units are a row each (their
number and length); a window's running sums turn numbers into offsets; requests, two unit numbers a text drawn from a hash
of its id, meet the units by number; the offsets found are gathered per text, and substrings make the output.

Half of the texts stay plain and take no part in all that: they are counted where they are scanned.  The others are
dealt out once by a hash of id and text; units are made after that exchange and are as wide as their numbers only, so
windows, joins and sums need no other exchange, and the three readers of the exchange share it.  A text's units are
sorted in one task; a text is one value of a row, so nothing but its own length bounds them.

Defined results: a null text is an empty one, and plain; a null doc_id draws as if its decimal form were empty; rows
that share doc_id and text are combined before they are dealt out and come back as often as they came; texts of any
length are cut whole, and so are texts of white space alone; a text that holds a mark is plain, so marks in an output
are always the operator's; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What the draws are seeded with; of 100 texts, how many are transformed; of 100 of those, how many have the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
_KEY = ["k1", "k2"]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _n_units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of each row."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    d = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    d = d.withColumn("plain", (F.col("text") == "") | marked | (h3 % 100 >= rate))
    none = F.lit(None).cast("long")
    plain = d.where("plain").select("doc_id", _n_units(F.col("text")).alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    keyed = d.where("not plain").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(seed), "text", "doc_id").alias("k2"))
    one = keyed.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "text")).alias("d"), F.count("*").alias("copies"))
    # all readers ask for the same columns of the exchange, or Spark would not share it
    one = one.where("copies > 0").select(*_KEY, "d.doc_id", "d.text", "copies")

    units = one.where("copies > 0").select(*_KEY, F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("no", "unit"))
    units = units.select(*_KEY, (F.col("no") + 1).alias("no"), F.length("unit").alias("chars"))
    running = Window.partitionBy(*_KEY).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.withColumn("end", F.sum("chars").over(running))

    asked = one.withColumn("n", _n_units(F.col("text")))
    asked = asked.withColumns({"first": F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), "second": F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))})
    requests = asked.where("copies > 0").select(*[F.col(k).alias(f"_{k}") for k in _KEY], "first", "second")
    met = ends.join(requests, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & ((F.col("no") == F.col("first")) | (F.col("no") == F.col("second"))))
    offset = lambda which: F.max(F.when(F.col("no") == F.col(which), F.col("end"))).alias(f"{which}_end")
    offsets = met.groupBy(*_KEY).agg(offset("first"), offset("second"))

    # no unit ends at number 0
    c = asked.join(offsets, _KEY, "left").withColumns({"p": F.coalesce("first_end", F.lit(0)), "m": F.coalesce("second_end", F.lit(0))})
    text, p, m = F.col("text"), F.col("p").cast("int"), F.col("m").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m - p), F.substring(text, m + 1, F.length(text))
    spm = h4 % 100 < suffix_first
    output = F.when(spm, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    cut = c.select("doc_id", "n", F.when(spm, "spm").otherwise("psm").alias("form"), F.col("p").alias("prefix_chars"), (F.col("m") - F.col("p")).alias("middle_chars"), output.alias("output"), "copies")
    again = cut.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    return plain.union(again)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of each output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_DRAW = "('0x' || substr(h, {0}, 8))::BIGINT"
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u FROM documents
), f AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, {_DRAW.format(1)} % (len(u) + 1) AS a, {_DRAW.format(9)} % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_DRAW.format(17)} % 100 >= {RATE} THEN 'plain' WHEN {_DRAW.format(25)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
