"""Reports that are one document by their format, written by tasks.

A document is a sequence of pieces: what stands before the findings, a piece a finding in report order, what stands after. The place
of each piece and, by running sums of lengths, its byte are known before anything is written (``placed``), so
each task writes its range of pieces where it belongs. ``Report`` ("report") is the data source that does it: tasks of a job write into
one hidden file, and a repeated attempt writes the same bytes to the same place; the commit counts the bytes of all tasks and gives the file
its name; an abort deletes it. No piece of the document passes the driver. Where the folder is not on a file system that can be written at an
offset (a store of objects), tasks write parts, and the commit alone streams them into one, 8 MB at a time.

A workbook is a zip archive, whose entries are stored and so are ranges of bytes too. Its headers hold checksums, which
the commit combines from those of the tasks' ranges. A workbook must stay below 4 GB, and other formats have no bound.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from girder.plans.ordered import placed
from girder.plans.scratch import Scratch

PIECES = "entry int, at long, data binary"
BUFFER = 8 << 20


def combined(a: int, b: int, length: int) -> int:
    """The CRC-32 of two byte strings in a row, of those of each and the length of the second: the first times x**(8 * length), plus the second."""

    def times(p: int, q: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            out ^= q if p >> bit & 1 else 0
            q = q >> 1 ^ (0xEDB88320 if q & 1 else 0)
        return out

    power, square, n = 1 << 31, 1 << 30, 8 * length
    while n:
        power, square, n = times(square, power) if n & 1 else power, times(square, square), n >> 1
    return times(power, a) ^ b


@dataclass
class Written(WriterCommitMessage):
    """Ranges of bytes: (entry, first byte, bytes, checksum)."""

    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)


class Report(DataSource):
    """Writes ``PIECES`` into one file. Options: path, job, size (bytes of all pieces), entries (JSON: name, first byte and bytes of each entry of a workbook)."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ReportWriter(self.options["path"], self.options["job"], int(self.options["size"]), json.loads(self.options.get("entries", "[]")))


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str, size: int, entries: list):
        self.size, self.entries = size, entries
        self.fs, self.path = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
        folder, _, name = self.path.rpartition("/")
        self.local = isinstance(self.fs, pa.fs.LocalFileSystem)
        self.hidden = f"{folder}/.{name}.{job}"

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "fs"} | {"uri": None if self.local else self.fs}

    def __setstate__(self, state):
        self.fs = state.pop("uri") or pa.fs.LocalFileSystem()
        self.__dict__.update(state)

    def _put(self, at: int, data: bytes) -> None:
        if self.local:
            out = os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                view, k = memoryview(data), 0
                while k < len(view):
                    k += os.pwrite(out, view[k:], at + k)
            finally:
                os.close(out)
        else:
            with self.fs.open_output_stream(f"{self.hidden}/{at:020d}") as out:
                out.write(data)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[int, int, int, int]] = []
        entry, at, parts, size = -1, 0, [], 0

        def close() -> None:
            nonlocal parts, size
            if parts:
                data = b"".join(parts)
                self._put(at, data)
                done.append((entry, at, len(data), zlib.crc32(data)))
            parts, size = [], 0

        self.fs.create_dir(self.hidden.rpartition("/")[0] if self.local else self.hidden)
        for batch in iterator:
            for e, a, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if e != entry or a != at + size or size >= BUFFER:
                    close()
                    entry, at = e, a
                parts.append(data)
                size += len(data)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        ranges = sorted(set(x for m in messages if m for x in m.ranges), key=lambda x: x[1])
        if sum(x[2] for x in ranges) != self.size:
            self.abort(messages)
            raise ValueError(f"{sum(x[2] for x in ranges)} bytes were written where {self.size} belong")
        if not self.local:
            with self.fs.open_output_stream(self.path) as out:
                for _, at, _, _ in ranges:
                    with self.fs.open_input_stream(f"{self.hidden}/{at:020d}") as part:
                        while data := part.read(BUFFER):
                            out.write(data)
            self.fs.delete_dir(self.hidden)
            return
        if self.entries:
            for at, data in archive_headers(self.entries, ranges):
                self._put(at, data)
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if self.local and os.path.exists(self.hidden):
            os.remove(self.hidden)
        elif not self.local:
            self.fs.delete_dir_contents(self.hidden, missing_dir_ok=True)


def archive_headers(entries: list, ranges: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, bytes]]:
    """The headers before the entries of a zip archive and the directory after them, with the byte at which each goes."""
    directory, end = [], 0
    for k, (name, start, size) in enumerate(entries):
        crc = 0
        for _, _, n, c in (x for x in ranges if x[0] == k):
            crc = combined(crc, c, n)
        what = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, crc, size, size, len(name.encode()), 0)
        at = start - header_bytes(name)
        yield at, b"PK\x03\x04" + what + name.encode()
        directory.append(b"PK\x01\x02" + struct.pack("<H", 20) + what + struct.pack("<HHHII", 0, 0, 0, 0, at) + name.encode())
        end = start + size
    table = b"".join(directory)
    yield end, table + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(table), end, 0)


def header_bytes(name: str) -> int:
    return 30 + len(name.encode())


def put(pieces: DataFrame, path: str, size: int, entries: list | None = None) -> None:
    spark = pieces.sparkSession
    spark.dataSource.register(Report)
    rows = pieces.select(F.col("entry").cast("int").alias("entry"), F.col("at").cast("long").alias("at"), "data")
    rows = rows.repartitionByRange("at").sortWithinPartitions("at")
    write = rows.write.format("report").option("job", uuid.uuid4().hex).option("size", size)
    write.option("entries", json.dumps(entries or [])).mode("append").save(path)


def in_order(findings: DataFrame, scratch: Scratch) -> DataFrame:
    """Findings with their ``place`` in report order, from 0."""
    return scratch.save(placed(findings, scratch, "report", ["file_path", "line", F.coalesce("col", F.lit(0)), "rule_id", "input_pos"]), "placed")


def laid_out(pieces: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(entry, section, key, data, at): pieces with their byte within all pieces of their entry, in order of (section, key)."""
    sized = pieces.withColumn("bytes", F.octet_length("data").cast("long"))
    return scratch.save(placed(sized, scratch, name, ["section", "key"], ["entry"], ["bytes"]).withColumn("at", F.col("bytes_to") - F.col("bytes")).drop("bytes_to", "place"), f"{name}-laid")


def _pieces(rows: DataFrame, entry: int, section: int, key: Column | str, text: Column) -> DataFrame:
    return rows.select(F.lit(entry).alias("entry"), F.lit(section).alias("section"), (F.col(key) if isinstance(key, str) else key).cast("long").alias("key"), text.cast("binary").alias("data"))


def _alone(findings: DataFrame, entry: int, section: int, text: bytes | str) -> DataFrame:
    return _pieces(findings.sparkSession.range(1), entry, section, F.lit(0), F.lit(text.encode() if isinstance(text, str) else text))


def joined(rows: DataFrame, n: int, value: Column, head: str, tail: str, path: str, between: str = "\n") -> None:
    """One document of ``head``, a piece for each of the n rows (place) with ``between`` in between, and ``tail``."""
    scratch = Scratch(rows.sparkSession, "document")
    each = _pieces(rows, 0, 1, "place", F.concat(F.coalesce(value, F.lit("")), F.when(F.col("place") < n - 1, F.lit(between)).otherwise(F.lit(""))))
    laid = laid_out(_alone(rows, 0, 0, head).union(each).union(_alone(rows, 0, 2, tail)), scratch, "document")
    put(laid, path, laid.agg(F.sum("bytes")).first()[0])


def _xml(c: Column) -> Column:
    """Text for XML: without characters that it forbids, escaped."""
    out = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^\\t\\n\\r\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _place() -> Column:
    return F.concat(F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")))


def sarif(findings: DataFrame, path: str) -> None:
    from girder.sources.sinks import sarif_rows

    scratch = Scratch(findings.sparkSession, "sarif")
    rows = in_order(findings, scratch)
    rules = [{"id": r[0]} for r in findings.select("rule_id").distinct().orderBy("rule_id").collect()]  # as many as there are rules
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"girder","rules":' + json.dumps(rules) + '}},"results":[\n'
    joined(sarif_rows(rows, "place"), rows.count(), F.col("value"), head, "\n]}]}\n", path, ",\n")


def gitlab(findings: DataFrame, path: str) -> None:
    from girder.sources.sinks import gitlab_rows

    rows = in_order(findings, Scratch(findings.sparkSession, "gitlab"))
    joined(gitlab_rows(rows, "place"), rows.count(), F.col("value"), "[\n", "\n]\n", path, ",\n")


def cyclonedx(findings: DataFrame, path: str) -> None:
    from girder.sources.sinks import cyclonedx_rows

    rows = in_order(findings, Scratch(findings.sparkSession, "cyclonedx"))
    joined(cyclonedx_rows(rows, "place"), rows.count(), F.col("value"), '{"bomFormat":"CycloneDX","specVersion":"1.6","version":1,"vulnerabilities":[\n', "\n]}\n", path, ",\n")


def html(findings: DataFrame, path: str) -> None:
    from girder.sources.sinks import html_rows

    rows = in_order(findings, Scratch(findings.sparkSession, "html"))
    joined(html_rows(rows, "place"), rows.count(), F.col("value"), "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Findings</title></head><body><table>\n", "\n</table></body></html>\n", path)


def junit(findings: DataFrame, path: str, threshold: str = "HIGH") -> None:
    """A test case a finding, which fails at the threshold and above; one that passes where nothing was found."""
    from girder.sources.sinks import RANK

    rows = in_order(findings, Scratch(findings.sparkSession, "junit"))
    over = F.col("severity").isin([k for k, v in RANK.items() if v >= RANK[threshold]])
    total, failed = rows.agg(F.count("*"), F.count_if(over)).first()
    case = F.concat(F.lit('<testcase name="'), _xml(F.concat_ws(" ", "rule_id", _place())), F.lit('">'), F.when(over, F.concat(F.lit('<failure message="'), _xml(F.col("severity")), F.lit('"/>'))).otherwise(""), F.lit("</testcase>"))
    joined(rows, total, case, f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="girder" tests="{max(total, 1)}" failures="{failed}">\n' + ("" if total else '<testcase name="clean"/>'), "\n</testsuite>\n", path)


def pdf(findings: DataFrame, path: str, per_page: int = 45) -> None:
    """Plain text pages: a row a page object, and its bytes are what the table at the end refers to. Characters beyond Latin-1 become question marks."""
    spark = findings.sparkSession
    scratch = Scratch(spark, "pdf")
    rows = in_order(findings, scratch)
    n = rows.count()
    pad = lambda c, k: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(k) - F.length(c), F.lit(0))))
    line = F.concat_ws(" ", pad(F.coalesce("severity", F.lit("")), 9), pad(F.coalesce("rule_id", F.lit("")), 12), _place())
    lines = rows.select("place", line.alias("line")) if n else spark.range(1).select(F.col("id").alias("place"), F.lit("no findings").alias("line"))
    safe = F.regexp_replace(F.regexp_replace("line", r"[\\()]", r"\\$0"), r"[^\x20-\x7E\xA0-\xFF]", "?")
    pages = lines.select(F.floor(F.col("place") / per_page).alias("page"), "place", F.concat(F.lit("("), safe, F.lit(") Tj T*")).alias("shown"))
    pages = pages.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]), "\n").alias("text"))
    text = F.concat(F.lit("BT /F1 9 Tf 40 800 Td 14 TL\n"), "text", F.lit("\nET"))
    number = lambda k: (2 * F.col("page") + k).cast("string")
    one = F.concat(number(4), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents "), number(5), F.lit(" 0 R >>\nendobj\n"))
    two = F.concat(number(5), F.lit(" 0 obj\n<< /Length "), F.length(text).cast("string"), F.lit(" >>\nstream\n"), text, F.lit("\nendstream\nendobj\n"))
    count = -(-max(n, 1) // per_page)
    first = "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    head = f"%PDF-1.4\n{first}2 0 obj\n<< /Type /Pages /Count {count} /Kids [\n"
    middle, font = "] >>\nendobj\n", "3 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>\nendobj\n"
    kids = _pieces(pages, 0, 1, "page", F.concat(number(4), F.lit(" 0 R\n")))
    bodies = pages.select(F.lit(0).alias("entry"), F.lit(3).alias("section"), F.col("page").cast("long").alias("key"), F.encode(F.concat(one, two), "ISO-8859-1").alias("data"), F.length(one).cast("long").alias("inner"))
    body = _alone(findings, 0, 0, head).union(kids).union(_alone(findings, 0, 2, middle + font)).withColumn("inner", F.lit(0).cast("long")).unionByName(bodies)
    laid = laid_out(body, scratch, "pdf")
    total = laid.agg(F.sum("bytes")).first()[0]
    after = laid.where("section = 2").first()["at"]
    entry = lambda at: F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    table = f"xref\n0 {4 + 2 * count}\n0000000000 65535 f \n".encode() + b"".join(f"{x:010d} 00000 n \n".encode() for x in (9, 9 + len(first), after + len(middle)))
    refs = laid.where("section = 3").select(F.lit(0).alias("entry"), (total + len(table) + 40 * F.col("key")).alias("at"), F.concat(entry(F.col("at")), entry(F.col("at") + F.col("inner"))).cast("binary").alias("data"))
    end = total + len(table) + 40 * count
    tail = f"trailer\n<< /Size {4 + 2 * count} /Root 1 0 R >>\nstartxref\n{total}\n%%EOF\n".encode()
    extra = spark.createDataFrame([(0, total, table), (0, end, tail)], PIECES)
    put(laid.select("entry", "at", "data").union(refs).union(extra), path, end + len(tail))


def excel(findings: DataFrame, path: str, sheet_rows: int | None = None) -> None:
    """A workbook with inline strings; a table that is too long for a sheet goes on in further ones."""
    from girder.sources.sinks import SHEET_ROWS, workbook

    spark = findings.sparkSession
    scratch, per, pieces, names, entries = Scratch(spark, "excel"), (sheet_rows or SHEET_ROWS) - 1, None, [], []
    for name, rows in workbook(findings).items():
        order = ["file_path", "line", "rule_id", "severity"] if name == "Findings" else rows.columns
        numbered = scratch.save(placed(rows, scratch, f"sheet-{len(names)}", order), f"sheet-{len(names)}-placed")
        sheets = -(-max(numbered.count(), 1) // per)
        safe = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
        cells = [F.concat(F.lit("<c t='inlineStr'><is><t xml:space='preserve'>"), _xml(F.when(c.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), c)).otherwise(c)), F.lit("</t></is></c>")) for c in safe]
        row = F.concat(F.lit("<row r='"), (F.col("place") % per + 2).cast("string"), F.lit("'>"), *cells, F.lit("</row>\n"))
        head = "<row r='1'>" + "".join(f"<c t='inlineStr'><is><t>{c}</t></is></c>" for c in rows.columns) + "</row>\n"
        of = numbered.select((F.floor(F.col("place") / per) + len(names)).cast("int").alias("entry"), F.lit(1).alias("section"), F.col("place").alias("key"), row.cast("binary").alias("data"))
        for k in range(sheets):
            entry, names = len(names), [*names, name if k == 0 else f"{name} {k + 1}"]
            top = _alone(findings, entry, 0, f"<?xml version='1.0' encoding='UTF-8'?>\n<worksheet xmlns='{_NS}/spreadsheetml/2006/main'><sheetData>\n{head}")
            part = top.union(_alone(findings, entry, 2, "</sheetData></worksheet>"))
            pieces = part if pieces is None else pieces.union(part)
        pieces = pieces.union(of)
    laid = laid_out(pieces, scratch, "excel")
    sizes = {r["entry"]: r["n"] for r in laid.groupBy("entry").agg(F.sum("bytes").alias("n")).collect()}
    fixed = _book(names)
    at, starts = 0, []
    for k, name in enumerate([*(f"xl/worksheets/sheet{i + 1}.xml" for i in range(len(names))), *fixed]):
        size = sizes[k] if k < len(names) else len(fixed[name].encode())
        at += header_bytes(name)
        entries.append((name, at, size))
        starts.append(at)
        at += size
    if at >= 1 << 32:
        raise ValueError("a workbook must stay below 4 GB")
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("entry") + 1)
    small = spark.createDataFrame([(len(names) + i, starts[len(names) + i], text.encode()) for i, text in enumerate(fixed.values())], PIECES)
    put(laid.select("entry", (F.col("at") + base).alias("at"), "data").union(small), path, sum(x[2] for x in entries), entries)


def sheet_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, value): the lines of each sheet of a workbook, by ranges of bytes; the driver reads the archive's directory alone."""
    fs, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    ranges = []
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as book:
        names = re.findall(r"<sheet name='([^']*)'", book.read("xl/workbook.xml").decode())
        for k, name in enumerate(names, 1):
            entry = book.getinfo(f"xl/worksheets/sheet{k}.xml")
            start = entry.header_offset + header_bytes(entry.filename)
            ranges += [(name, begin, min(begin + BUFFER, start + entry.file_size), start, start + entry.file_size) for begin in range(start, start + entry.file_size, BUFFER)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
        with fs.open_input_file(at) as f:
            for b in batches:
                for name, begin, end, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    # the lines that begin in the range: the first one begins after a line's end, the last one may go on beyond
                    f.seek(max(begin - 1, first))
                    data = f.read(end - max(begin - 1, first))
                    if begin > first:
                        _, found, data = data.partition(b"\n")
                        if not found:
                            continue
                    if not data:
                        continue
                    while not data.endswith(b"\n") and f.tell() < last:
                        more = f.read(min(1 << 16, last - f.tell()))
                        line, found, _ = more.partition(b"\n")
                        data += line + found
                        if found:
                            break
                    lines = data.decode().split("\n")
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines)], ["sheet", "value"])

    rows = spark.createDataFrame(ranges, "name string, begin long, end long, first long, last long").repartition(len(ranges))
    return rows.mapInArrow(read, "sheet string, value string").where("value <> ''")


#: What the format asks for beside the sheets.
_NS = "http://schemas.openxmlformats.org"


def _book(names: list[str]) -> dict[str, str]:
    numbered = list(enumerate(names, 1))
    types = "".join(f"<Override PartName='/xl/worksheets/sheet{k}.xml' ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml'/>" for k, _ in numbered)
    return {
        "[Content_Types].xml": f"<Types xmlns='{_NS}/package/2006/content-types'><Default Extension='rels' ContentType='application/vnd.openxmlformats-package.relationships+xml'/><Override PartName='/xl/workbook.xml' ContentType='application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml'/>{types}</Types>",
        "_rels/.rels": f"<Relationships xmlns='{_NS}/package/2006/relationships'><Relationship Id='r1' Type='{_NS}/officeDocument/2006/relationships/officeDocument' Target='xl/workbook.xml'/></Relationships>",
        "xl/workbook.xml": f"<workbook xmlns='{_NS}/spreadsheetml/2006/main' xmlns:r='{_NS}/officeDocument/2006/relationships'><sheets>" + "".join(f"<sheet name='{v}' sheetId='{k}' r:id='r{k}'/>" for k, v in numbered) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"<Relationships xmlns='{_NS}/package/2006/relationships'>" + "".join(f"<Relationship Id='r{k}' Type='{_NS}/officeDocument/2006/relationships/worksheet' Target='worksheets/sheet{k}.xml'/>" for k, _ in numbered) + "</Relationships>",
    }


FORMATS = {"sarif": sarif, "gitlab": gitlab, "cyclonedx": cyclonedx, "html": html, "junit": junit, "pdf": pdf, "excel": excel}


def write(findings: DataFrame, kind: str, path: str, **options) -> None:
    """One document of all findings at ``path``."""
    FORMATS[kind](findings, path, **options)
