"""A data source for mbox files, and a reader of folders of .eml and .mbox files.

spark.dataSource.register(MboxDataSource); spark.read.format("mbox").load(path).  Large files
are read in byte ranges: a range has the messages whose separator line begins in it, so no
message is split or read twice.  Messages are streamed; only one is in memory at a time.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, offset bigint, from_line string, separator_date string, raw binary, size bigint"
SPLIT_BYTES = 64 << 20
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def separator_date(line: str) -> str | None:
    """RFC 3339 date of 'From address Www Mon D HH:MM:SS YYYY [zone]'; an unknown or missing zone is UTC."""
    t = line.split()
    if len(t) < 7 or t[0] != "From":
        return None
    for at in range(2, len(t) - 4):
        _, month, day, clock, year = t[at : at + 5]
        zone = t[at + 5] if len(t) > at + 5 else ""
        if month[:3].lower() not in MONTHS or not re.fullmatch(r"\d{1,2}:\d\d(:\d\d)?", clock) or not day.isdigit() or not re.fullmatch(r"\d{4}", year):
            continue
        sign = re.fullmatch(r"([+-])(\d\d):?(\d\d)", zone)
        shift = timedelta(hours=int(sign[2]), minutes=int(sign[3])) * (-1 if sign[1] == "-" else 1) if sign else timedelta()
        try:
            h, m, *s = map(int, clock.split(":"))
            return datetime(int(year), MONTHS.index(month[:3].lower()) + 1, int(day), h, m, *(s or [0]), tzinfo=timezone(shift)).isoformat()
        except ValueError:
            return None
    return None


def is_separator(line: bytes, strict: bool = False) -> bool:
    """Whether a line begins a message; strict asks for a date."""
    return line.startswith(b"From ") and (not strict or separator_date(line.decode("utf-8", "replace")) is not None)


def messages(path: str, start: int = 0, end: int | None = None, strict: bool = False, most: int | None = None) -> Iterator[tuple[str, int, str, str | None, bytes]]:
    """Messages whose separator begins at start or after it, before end; '>From ' in bodies loses its mark."""
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the rest of a line that began in an earlier range, or nothing but a line feed
        at, head, lines, body, given = f.tell(), None, [], False, 0
        for line in f:
            here, at = at, at + len(line)
            if is_separator(line, strict):
                if head:
                    yield path, head[0], head[1], separator_date(head[1]), b"".join(lines)
                    given += 1
                    head = None
                if end is not None and here >= end or most is not None and given >= most:
                    return
                head, lines, body = (here, line.decode("utf-8", "replace").rstrip("\r\n")), [], False
            elif head:
                if body and line.startswith(b">From "):
                    line = line[1:]
                body = body or not line.strip(b"\r\n")
                lines.append(line)
            elif end is not None and here >= end:
                return
        if head and (most is None or given < most):
            yield path, head[0], head[1], separator_date(head[1]), b"".join(lines)


def local(path: str) -> str:
    """A path without the scheme of the local file system; mbox ranges are read by the executors from a file system that is mounted on all."""
    return re.sub("^file:(?://)?(?=/)", "", path)


def header_bytes(raw: bytes) -> bytes:
    """What comes before the first empty line (S07): bodies don't leave the reader."""
    at = raw.find(b"\r\n\r\n")
    at = raw.find(b"\n\n") if at < 0 else at
    return raw if at < 0 else raw[:at]


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class MboxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        given = options["path"]
        named = json.loads(given) if given.startswith("[") else [given]
        self.paths = sorted(p for g in named for p in glob.glob(local(g)) or [local(g)])
        self.headers = str(options.get("headersOnly", "false")).lower() == "true"
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.most = int(options["maxMessages"]) if options.get("maxMessages") else None
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            size = os.path.getsize(p)
            # a limit counts from the file's start, so such a file is one range
            step = self.split if self.most is None else max(size, 1)
            out += [Range(p, s, min(s + step, size)) for s in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.path:
            for path, at, head, date, raw in messages(partition.path, partition.start, partition.end, self.strict, self.most):
                yield (path, at, head, date, header_bytes(raw) if self.headers else raw, len(raw))


class MboxDataSource(DataSource):
    """Options: strict (false), headersOnly (false), maxMessages per file, splitBytes; the path may be a list in JSON."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MboxReader(self.options)  # names in any case


def read_folder(spark: SparkSession, folder: str, recursive: bool = True, strict: bool = False) -> DataFrame:
    """All .eml and .mbox files of a folder, in upper or lower case, as rows of SCHEMA (S08).  The mbox files are one scan."""
    spark.dataSource.register(MboxDataSource)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[eE][mM][lL]").load(folder)
    none = F.lit(None).cast("string")
    out = files.select("path", F.lit(0).cast("long").alias("offset"), none.alias("from_line"), none.alias("separator_date"), F.col("content").alias("raw"), F.col("length").alias("size"))
    root = local(folder)
    found = sorted(p for p in glob.glob(f"{root}/**/*" if recursive else f"{root}/*", recursive=recursive) if p.lower().endswith(".mbox"))
    return out.unionByName(spark.read.format("mbox").option("strict", str(strict).lower()).load(json.dumps(found))) if found else out
