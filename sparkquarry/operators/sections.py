"""Sections and content groups of documents: running windows over ordered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import first_match, lookup, strict_patterns, strip

UNTITLED = "Document Content"
_LIST = "^\\s*(?:•|\\-|\\d+\\.|\\w\\))"


def section_type(heading: Column, strict: bool = False, ner: bool = False) -> Column:
    """A heading's type by the ordered pattern table; strict bounds words, so that "reactions" holds no "ct"."""
    table = vocab.NER_SECTIONS if ner else vocab.SECTIONS
    return first_match(heading, strict_patterns(table) if strict else table)


def boost_section(kind: Column, backfill: bool = False) -> Column:
    return lookup(kind, vocab.BACKFILL_BOOST_SECTIONS if backfill else vocab.BOOST_SECTIONS)


def is_list_item(content: Column) -> Column:
    return content.rlike(_LIST)


def with_sections(items: DataFrame, compat: bool = False, strict: bool = False, ner: bool = False) -> DataFrame:
    """Items below their section: section_id, section_title, section_level, section_type; headings themselves go.

    What stands before the first heading is a section of its own; compat drops it where a document has headings.
    One sort by document serves all windows.
    """
    w = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("type") == "heading"
    s = items.withColumn("section_id", F.sum(heading.cast("int")).over(w))
    s = s.withColumns({"section_title": F.last(F.when(heading, strip(F.col("content"))), ignorenulls=True).over(w), "section_level": F.last(F.when(heading, F.coalesce("level", F.lit(1))), ignorenulls=True).over(w)})
    if compat:
        s = s.withColumn("_has", F.max(heading).over(Window.partitionBy("job_id"))).where((F.col("section_id") > 0) | ~F.col("_has")).drop("_has")
    s = s.where(~heading).withColumns({"section_title": F.coalesce("section_title", F.lit(UNTITLED)), "section_level": F.coalesce("section_level", F.lit(0))})
    return s.withColumn("section_type", F.when(F.col("section_id") > 0, section_type(F.col("section_title"), strict, ner)))


def with_groups(sectioned: DataFrame) -> DataFrame:
    """Add group_kind (list, table, text) and group_id: list items that follow one another share a group."""
    w = Window.partitionBy("job_id").orderBy("ord")
    g = sectioned.withColumn("group_kind", F.when(is_list_item(F.col("content")), "list").when(F.col("type") == "table", "table").otherwise("text"))
    follows = (F.col("group_kind") == "list") & (F.lag("group_kind").over(w) == "list") & (F.lag("section_id").over(w) == F.col("section_id"))
    g = g.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    return g.withColumn("group_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
