"""Parsed documents as a data source: files of one document a line, in batches or as a stream, read in byte ranges.

Rows are job_id, document (its JSON), rejected (why a line is no document, else null), file and at (the byte where the line
begins), so nothing that a file holds is lost.  A parser is named by ``parser``, as module:function: it takes a line and
returns the JSON of a document, or raises ValueError with the reason; by default lines are that JSON themselves.

Files are found and opened by ``pyarrow.fs``, so paths are local ones or those of a store that it knows.  Names that begin
with a dot or an underscore are passed over; compressed files are read by one task each.  As a stream, files come in the
order of their times; they have to appear whole, and one that appears with an earlier time than those read is not seen.
"""

from __future__ import annotations

import importlib
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "parsed_documents"
#: Bytes of a file that one task reads.
RANGE = 64 << 20
_ROW = "job_id string, document string, rejected string, file string, at long"


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def as_it_is(line: str) -> str:
    """The default parser: a JSON object with a job_id."""
    try:
        found = json.loads(line)
    except ValueError:
        raise ValueError("no JSON") from None
    if not isinstance(found, dict):
        raise ValueError("no object")
    if not isinstance(found.get("job_id"), str) or not found["job_id"]:
        raise ValueError("no job_id")
    return line


def tabbed(line: str) -> str:
    """A parser of lines that hold an id, a tab, and the text of a page."""
    job_id, _, text = line.partition("\t")
    if not job_id or not text:
        raise ValueError("no id" if text else "no text")
    return json.dumps({"job_id": job_id, "pages": [{"page": 1, "text": text}]}, ensure_ascii=False)


class _Files:
    """What batches and streams share."""

    def __init__(self, options: dict):
        self.path, self.size = re.sub("^file:/+", "/", options["path"]), int(options.get("range_bytes", RANGE))
        module, _, name = options.get("parser", f"{__name__}:as_it_is").partition(":")
        self.module, self.name = module, name

    def _listed(self) -> list[tuple[int, str, int]]:
        """(time, path, size) of each file, in order."""
        store, base = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True)) if store.get_file_info(base).type == fs.FileType.Directory else [store.get_file_info(base)]
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")

    def _ranges(self, files: list[tuple[int, str, int]]) -> list[Range]:
        out = []
        for _, path, size in files:
            whole = path.endswith((".gz", ".bz2", ".zst"))
            out += [Range(path, a, size if whole else min(a + self.size, size)) for a in ([0] if whole else range(0, size, self.size))]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        parse = getattr(importlib.import_module(self.module), self.name)
        store = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        if part.path.endswith((".gz", ".bz2", ".zst")):
            file, last = io.BufferedReader(store.open_input_stream(part.path)), None
        else:
            file, last = io.BufferedReader(store.open_input_file(part.path)), part.end
        with file:
            at = part.begin
            if at:
                # the line that begins before the range is its neighbour's
                file.seek(at - 1)
                at += len(file.readline()) - 1
            while last is None or at < last:
                line = file.readline()
                if not line:
                    return
                try:
                    text = line.decode().strip("\r\n")
                    if text.strip():
                        document = parse(text)
                        yield json.loads(document)["job_id"], document, None, part.path, at
                except ValueError as e:
                    yield None, line.decode(errors="replace").strip("\r\n"), str(e) if not isinstance(e, UnicodeDecodeError) else "no UTF-8", part.path, at
                at += len(line)


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self._ranges(self._listed()) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        return super().read(part) if part.path else iter(())


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self._ranges([f for f in self._listed() if after < f[:2] <= upto])


class ParsedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _ROW

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def read(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """The rows of the source; see documents() for documents with their pages."""
    spark.dataSource.register(ParsedDocuments)
    return (spark.readStream if stream else spark.read).format(NAME).options(**options).load(path)


def documents(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents by a schema, lines that are none). What a document lacks is null."""
    good = rows.where("rejected is null").select(F.from_json("document", schema).alias("d")).select("d.*")
    return good, rows.where("rejected is not null")
