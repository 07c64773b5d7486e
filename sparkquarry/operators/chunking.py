"""Documents to token-bounded chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import subwords, vocab
from ..functions.text import TOKEN, let, strip, token_count, tokens, windows, words
from ..sources.documents import items, ocr_text
from .sections import with_groups, with_sections

#: Tokens of a plain chunk and its overlap, smallest last window; of a section's chunk and its overlap; of a table's chunk.
SIZE, OVERLAP, LEAST, SECTION_SIZE, SECTION_OVERLAP, TABLE_SIZE = 512, 50, 100, 384, 64, 768
#: Words from which the plain chunker keeps a heading.
HEADING_WORDS = 15
_TOKEN = re.compile(TOKEN, re.ASCII)
CHUNK = ["job_id", "chunk_no", "chunk", "chunk_type", "page", "page_width", "page_height", "bbox", "section_title", "section_type"]


def merged_windows(c: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Overlapping windows of a token array; a last one below ``least`` is appended whole to the one before it."""

    def merge(w):
        n = F.size(w)
        short = (n > 1) & (F.size(F.element_at(w, -1)) < least)
        joined = F.concat(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.get(w, n - 2), F.get(w, n - 1))))
        return F.filter(F.when(short, joined).otherwise(w), lambda x: (n == 1) | (F.size(x) >= least))

    return let(windows(c, size, overlap), merge)


def split_plain(text: Column, pieces: tuple[str, ...] | None = None) -> Column:
    """A text's plain chunks: itself if it fits, else merged windows of its tokens.

    pieces: a model's vocabulary (see functions.subwords); windows are of its tokens then, cut out of the text as it stands.
    """
    if pieces is not None:
        return F.transform(subwords.split(text, pieces, SIZE, OVERLAP, LEAST), lambda c: c["chunk"])
    return F.transform(_plain()(text), lambda c: F.coalesce(c, strip(text)))


def _plain():
    """A function of a text column: its merged windows, tokens joined by spaces; one null, which stands for the text as it is, if it
    fits, and none without tokens or text. Cut in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                w = _TOKEN.findall(t) if t is not None else []
                parts = [w[a:b] for a, b in subwords.cut(len(w), SIZE, OVERLAP)]
                if len(parts) > 1 and len(parts[-1]) < LEAST:
                    # as in merged_windows, appended whole
                    parts[-2:] = [parts[-2] + parts[-1]]
                out.append([None] * bool(w) if len(w) <= SIZE else [" ".join(x) for x in parts])
            yield pd.Series(out, index=texts.index, dtype=object)

    return run


def split_in_section(context: Column, text: Column, pieces: tuple[str, ...] | None = None) -> Column:
    """A text's chunks with the section's context before each: whole if it fits, else windows of what the context leaves.

    pieces: a model's vocabulary; budgets are of its tokens then.
    """
    if pieces is not None:
        return subwords.split_after(context, text, pieces, SECTION_SIZE, SECTION_OVERLAP)
    t = tokens(text)
    left = F.greatest(F.lit(SECTION_SIZE) - token_count(context), F.lit(1))
    whole = token_count(F.concat(context, text)) <= SECTION_SIZE
    return F.when(whole, F.array(F.concat(context, text))).otherwise(F.transform(windows(t, left, SECTION_OVERLAP), lambda w: F.concat(context, F.array_join(w, " "))))


def table_type(rows: Column) -> Column:
    """lab_results, medications, vital_signs or generic by the header row's words; text without rows."""
    header = F.lower(F.array_join(F.get(rows, F.lit(0)), " "))
    out = F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "text")
    for kind, terms in vocab.TABLE_TYPES.items():
        out = out.when(header.rlike("|".join(terms)), kind)
    return out.otherwise("generic")


def row_text(row: Column) -> Column:
    return F.array_join(row, " | ")


def packed_rows(rows: Column, context: Column, budget: int = TABLE_SIZE) -> Column:
    """Data rows in parts whose tokens, with the context's, keep to the budget; a fold, since each part begins where the last ended."""
    start = F.struct(F.array(F.array().cast("array<array<string>>")).alias("parts"), token_count(context).alias("used"))

    def step(acc, row):
        n = token_count(row_text(row))
        last = F.element_at(acc["parts"], -1)
        # the first row of all never flushes: the header alone makes no part
        full = (acc["used"] + n > budget) & (F.size(last) > 0)
        grown = F.concat(F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1), F.array(F.array_append(last, row)))
        return F.struct(F.when(full, F.concat(acc["parts"], F.array(F.array(row)))).otherwise(grown).alias("parts"), F.when(full, token_count(context) + n).otherwise(acc["used"] + n).alias("used"))

    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)["parts"]


def table_chunks(context: Column, rows: Column, md: Column) -> Column:
    """Array of (chunk, chunk_type) of a table: labs packed with their header, a medication a chunk, others whole if they fit."""
    head = F.get(rows, F.lit(0))
    render = lambda part: F.concat(strip(context), F.lit("\n"), F.array_join(F.transform(part, row_text), "\n"))
    typed = lambda chunks, kind: F.transform(chunks, lambda c: F.struct(c.alias("chunk"), F.lit(kind).alias("chunk_type")))
    labs = F.transform(packed_rows(rows, context), lambda p: render(F.concat(F.array(head), p)))
    medications = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: render(F.array(head, r)))
    whole = F.concat(context, F.lit("\n"), F.coalesce(md, F.lit("")))
    kind = table_type(rows)
    return (
        F.when(kind == "lab_results", typed(labs, "lab_result"))
        .when(kind == "medications", typed(medications, "medication"))
        .when(token_count(whole) <= TABLE_SIZE, typed(F.array(whole), "table"))
        .otherwise(typed(split_in_section(context, F.coalesce(md, F.lit(""))), "text"))
    )


def with_page_size(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose page has no size take the one that their document's metadata name (page_width, page_height), if they do.

    Documents that share a job_id count as one, with the smallest width and height that they name; null ids equal each other.
    """
    if not {"page_width", "page_height"} <= {*documents.columns}:
        return chunks
    d = documents.groupBy(F.col("job_id").alias("_j")).agg(*[F.min(F.expr(f"try_cast({c} as double)")).alias(f"_{c}") for c in ("page_width", "page_height")])
    c = chunks.join(d, F.col("job_id").eqNullSafe(F.col("_j")), "left")
    return c.withColumns({n: F.coalesce(n, f"_{n}") for n in ("page_width", "page_height")}).select(*chunks.columns)


def size_text(size: Column) -> Column:
    """A page's width or height as payloads show it: NA where it is not known."""
    return F.coalesce(size.cast("string"), F.lit("NA"))


def _numbered(chunks: DataFrame, order: list) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(*order)
    return chunks.where(strip(F.col("chunk")) != "").withColumn("chunk", strip(F.col("chunk"))).withColumn("chunk_no", F.row_number().over(w) - 1).select(*CHUNK)


def section_chunks(source: DataFrame, compat: bool = False, strict: bool = False, ner: bool = False, pieces: tuple[str, ...] | None = None) -> DataFrame:
    """Chunks of items() below their sections.  compat drops lists over the limit and content before the first heading; ner
    takes text items only and its own section table.  pieces: a model's vocabulary, in whose tokens texts are windowed."""
    grouped = with_groups(with_sections(source, compat, strict, ner))
    if ner:
        grouped = grouped.where("type = 'text'").withColumn("group_kind", F.lit("text"))
    context = F.concat(F.lit("[Section: "), F.col("section_title"), F.lit("]\n"))
    # every group is a row: items of a list together, all others alone
    first = F.min(F.struct("ord", "group_kind", "page", "page_width", "page_height", "bbox", "section_title", "section_type", "rows", "content")).alias("f")
    g = grouped.groupBy("job_id", "section_id", "group_id", *(["ord"] if ner else [])).agg(first, F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("l"))
    none = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")
    is_list = F.col("f.group_kind") == "list"
    g = g.select("job_id", "f.ord", "f.group_kind", "f.page", "f.page_width", "f.page_height", F.when(is_list, none).otherwise(F.col("f.bbox")).alias("bbox"), "f.section_title", "f.section_type", "section_id", "group_id", "f.rows", F.when(is_list, F.array_join(F.col("l.content"), "\n")).otherwise(F.col("f.content")).alias("body"))
    typed = lambda c, kind: F.struct(c.alias("chunk"), F.lit(kind).alias("chunk_type"))
    empty = F.array().cast("array<struct<chunk:string,chunk_type:string>>")
    texts = F.transform(split_in_section(context, F.col("body"), pieces), lambda c: typed(c, "text"))
    text = F.concat(context, F.lit("\n"), F.col("body"))
    lists = F.when(token_count(text) <= SECTION_SIZE, F.array(typed(text, "list"))).otherwise(empty if compat else texts)
    chunks = F.when(F.col("group_kind") == "list", lists).when(F.col("group_kind") == "table", table_chunks(context, F.col("rows"), F.col("body"))).when(strip(F.col("body")) != "", texts).otherwise(empty)
    out = g.select("job_id", "ord", "page", "page_width", "page_height", "bbox", "section_title", "section_type", "section_id", "group_id", F.posexplode(chunks).alias("part", "c")).select("*", "c.chunk", "c.chunk_type").drop("c")
    return _numbered(out, ["section_id", "group_id", "ord", "part"])


def healthcare_chunks(parsed: DataFrame, compat: bool = False, strict: bool = False, ner: bool = False, pieces: tuple[str, ...] | None = None) -> DataFrame:
    return section_chunks(items(parsed, images=not ner), compat, strict, ner, pieces)


def generic_chunks(parsed: DataFrame, pieces: tuple[str, ...] | None = None) -> DataFrame:
    """Plain chunks page by page: images, then items with a box (headings of over 15 words, tables as tabs, texts), or the page's own text."""
    p = parsed.select("job_id", F.posexplode("pages").alias("p", "g")).where("g.page is not null")
    head = ["job_id", F.col("g.page").alias("page"), F.col("g.width").alias("page_width"), F.col("g.height").alias("page_height"), "p"]
    names = ["job_id", "page", "page_width", "page_height", "p"]
    box = lambda *c: F.struct(*[F.col(a).cast("double").alias(b) for a, b in zip(c, "xywh", strict=True)])
    whole = lambda b: b["x"].isNotNull() & b["y"].isNotNull() & b["w"].isNotNull() & b["h"].isNotNull()
    image = p.select(*head, F.posexplode("g.images").alias("i", "x")).select(*names, F.lit(0).alias("k"), "i", ocr_text(F.col("x.ocr")).alias("text"), box("x.x", "x.y", "x.width", "x.height").alias("bbox"), F.lit("image").alias("type"))
    item = p.select(*head, F.posexplode("g.items").alias("i", "x"))
    cells = F.array_join(F.transform("x.rows", lambda r: F.array_join(r, "\t")), "\n")
    body = F.coalesce(F.when(F.col("x.md") != "", F.col("x.md")), F.col("x.text"), F.lit(""))
    text = F.when((F.col("x.type") == "table") & (F.coalesce(F.size("x.rows"), F.lit(0)) > 0), cells).otherwise(body)
    item = item.select(*names, F.lit(1).alias("k"), "i", text.alias("text"), F.col("x.bBox").alias("bbox"), F.coalesce("x.type", F.lit("text")).alias("type"))
    page = p.where("coalesce(size(g.items), 0) <= 0").select(*head, "g").select(*names, F.lit(1).alias("k"), F.lit(0).alias("i"), F.coalesce(F.when(F.col("g.md") != "", F.col("g.md")), F.col("g.text"), F.lit("")).alias("text"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("page_width").alias("w"), F.col("page_height").alias("h")).alias("bbox"), F.lit("page").alias("type"))
    every = image.unionByName(item).unionByName(page).where(whole(F.col("bbox")))
    every = every.where((F.col("type") != "heading") | (F.size(words(F.col("text"))) > HEADING_WORDS))
    single = F.col("type").isin("image", "table", "heading")
    parts = F.when(single, F.array(strip(F.col("text")))).otherwise(split_plain(F.col("text"), pieces))
    out = every.select(*names, "k", "i", "bbox", F.col("type").alias("chunk_type"), F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("section_type"), F.posexplode(parts).alias("part", "chunk"))
    return _numbered(out, ["p", "k", "i", "part"])
