"""Chunkers of one's own: a Python function of a document's items as a table function over all documents.

The function gets a document's items in reading order (dicts of ord, type, level, content, page, page_width, page_height,
bbox, rows) and yields its chunks.  Spark brings a document's items together by PARTITION BY and sorts them; nothing else
of the collection is in the function's reach.  ``by_sections`` is such a function, for comparison and as a start for
others; over large collections ``chunking.section_chunks`` does the same without Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import vocab
from ..functions.text import TOKEN
from ..sources.documents import BOX
from .chunking import CHUNK, SECTION_OVERLAP, SECTION_SIZE, TABLE_SIZE
from .sections import _LIST, UNTITLED

_OUT = f"job_id string, chunk_no int, chunk string, chunk_type string, page int, page_width double, page_height double, bbox {BOX}, section_title string, section_type string"
_SPACE = " \t\n\x0b\f\r"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text, re.ASCII)


def split(context: str, text: str) -> list[str]:
    """The text after its context, whole if it fits, else in windows."""
    if len(tokens(context + text)) <= SECTION_SIZE:
        return [context + text]
    t, size = tokens(text), max(SECTION_SIZE - len(tokens(context)), 1)
    stride, out = max(size - SECTION_OVERLAP, 1), []
    for begin in range(0, len(t), stride):
        out.append(context + " ".join(t[begin : begin + size]))
        if begin + size >= len(t):
            break
    return out


def table(context: str, rows: list, text: str) -> Iterator[tuple[str, str]]:
    """(chunk, type) of a table: labs packed below their header, a medication a chunk, others whole if they fit."""
    line = lambda r: " | ".join(x for x in r if x is not None)
    render = lambda part: context.strip(_SPACE) + "\n" + "\n".join(map(line, part))
    header = " ".join(x for x in rows[0] if x is not None).lower() if rows else ""
    kind = next((k for k, terms in vocab.TABLE_TYPES.items() if re.search("|".join(terms), header, re.ASCII)), "generic") if rows else "text"
    if kind == "lab_results":
        part, used = [], len(tokens(context))
        for r in rows[1:]:
            n = len(tokens(line(r)))
            if part and used + n > TABLE_SIZE:
                yield render([rows[0], *part]), "lab_result"
                part, used = [], len(tokens(context))
            part.append(r)
            used += n
        yield render([rows[0], *part]), "lab_result"
    elif kind == "medications":
        for r in rows[1:]:
            yield render([rows[0], r]), "medication"
    elif len(tokens(f"{context}\n{text}")) <= TABLE_SIZE:
        yield f"{context}\n{text}", "table"
    else:
        for c in split(context, text):
            yield c, "text"


def by_sections(items: list[dict]) -> Iterator[dict]:
    """Chunks below their sections: lists together, tables by their kind, other texts one by one."""
    title, kind, held = UNTITLED, None, []

    def made(group: str, some: list[dict]) -> Iterator[dict]:
        context, first = f"[Section: {title}]\n", some[0]
        body = "\n".join(i["content"] for i in some)
        if group == "table":
            parts = table(context, first["rows"] or [], body)
        elif group == "list" and len(tokens(f"{context}\n{body}")) <= SECTION_SIZE:
            parts = [(f"{context}\n{body}", "list")]
        else:
            parts = [(c, "text") for c in split(context, body)] if body.strip(_SPACE) or group == "list" else []
        for chunk, chunk_type in parts:
            yield {"chunk": chunk, "chunk_type": chunk_type, **{c: first[c] for c in ("page", "page_width", "page_height")}, "bbox": None if group == "list" else first["bbox"], "section_title": title, "section_type": kind}

    for i in items:
        is_list = i["type"] != "heading" and re.search(_LIST, i["content"], re.ASCII)
        if held and not is_list:
            yield from made("list", held)
            held = []
        if i["type"] == "heading":
            title = i["content"].strip(_SPACE)
            kind = next((v for p, v in vocab.SECTIONS.items() if re.search(p, title.lower(), re.ASCII)), None)
        elif is_list:
            held.append(i)
        else:
            yield from made("table" if i["type"] == "table" else "text", [i])
    if held:
        yield from made("list", held)


def chunked(items: DataFrame, function: Callable[[list[dict]], Iterator[dict]] = by_sections) -> DataFrame:
    """The chunks that a function makes of each document's items (see sources.documents.items), blank ones left out."""

    class Chunker:
        def __init__(self):
            self.items: list[dict] = []

        def eval(self, row):
            self.items.append(row.asDict())

        def terminate(self):
            no = 0
            for c in function(self.items):
                if text := (c.get("chunk") or "").strip(" \t\n\x0b\f\r"):
                    b = c.get("bbox")
                    box = None if b is None else {k: b[k] for k in ("x", "y", "w", "h")}
                    yield self.items[0]["job_id"], no, text, c.get("chunk_type"), c.get("page"), c.get("page_width"), c.get("page_height"), box, c.get("section_title"), c.get("section_type")
                    no += 1

    make = udtf(Chunker, returnType=_OUT)
    return make(items.asTable().partitionBy("job_id").orderBy(F.col("ord"))).select(*CHUNK)
