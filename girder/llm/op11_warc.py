"""WARC archives whose records are compressed one by one with a Zstandard dictionary built from the archive's own records.

Each task writes archives of its own: it holds its first records, up to ``SAMPLE_BYTES``, trains a dictionary on them, writes
it as the archive's leading skippable frame (magic 0x184D2A5D) and then each record, those held first, as one frame. A reader
needs nothing but the file, and any record can be read from its offset with the dictionary of the first frame. Too few bytes to train on make an archive
without a dictionary, which is valid as well. An archive that has grown to ``FILE_BYTES`` is closed and another begun.

``WarcZst`` is the data source ("warczst") behind ``df.write`` and ``spark.read``. A task names its archives anew at each
attempt; the commit writes the list of those that count and deletes what lost attempts have left; readers go by that list.
Archives are written and read through pyarrow's file systems, by the URI of the folder.

Which record is the response is settled before any payload moves: sums by digest give, for payloads of ``LEAST_BYTES`` that
occur more than once, the largest id. That narrow table is written, and then met with the rows: broadcast by Spark where it is small,
else by a join whose hot keys adaptive execution splits. Rows that tie for a response (same payload, same id) are numbered, so
that just one is it. Reading back, a revisit finds its response by WARC-Refers-To.

Nulls: a null payload is an empty one; a null id goes before all others and is written as none; a null URL leaves out the
target. Control characters and blanks of a URL are percent-encoded. Equal rows make a record each. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from girder.llm.common import Scratch, is_empty, numbered, table

LEAST_BYTES = 1000
#: Records that a dictionary is trained on, and the bytes of the largest dictionary.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 112_640
#: A longer record is sampled in pieces of this size.
SAMPLE_PIECE = 32 << 10
FILE_BYTES = 1 << 30
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20
#: Fixed values of the formats: magic of the frame that holds a dictionary, the revisit profile, the header of an archived page.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LIST = "_archives.jsonl"
ROWS = "id long, url string, payload binary, payload_digest string, record_type string, refers_to long"
INDEX = "id long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, archive string, offset long, length long"


def record_urn(page_id: int | None, digest: str) -> str:
    """The id of a response that revisits can name: it follows from the page and the payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}"


def record(kind: str, record_id: str, headers: dict[str, str | None], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **headers, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record, names in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if len(rest) != length + 4:
        raise ValueError(f"record {fields.get('warc-record-id')}: {len(rest) - 4} bytes where {length} are stated")
    return fields, rest[:length]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on records; empty if they are too few."""
    pieces = [x[i : i + SAMPLE_PIECE] for x in samples for i in range(0, len(x), SAMPLE_PIECE)]
    if sum(map(len, pieces)) < 16 << 10:
        return b""
    if len(pieces) < 16:
        pieces = [x[i : i + 1024] for x in pieces for i in range(0, len(x), 1024)]
    try:
        size = min(DICTIONARY_BYTES, max(2048, sum(map(len, pieces)) // 24))
        return zstandard.train_dictionary(size, pieces, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # nothing repeats
        return b""


class Archive:
    """One archive while it is written."""

    def __init__(self, fs: pa.fs.FileSystem, folder: str, held: list[bytes]):
        self.fs, self.name = fs, f"part-{TaskContext.get().partitionId() if TaskContext.get() else 0:05d}-{uuid.uuid4().hex}.warc.zst"
        self.path = f"{folder}/{self.name}"
        trained = dictionary(held)
        self.by = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        self.out = fs.open_output_stream(self.path)
        self.records = self.bytes = 0
        if trained:
            self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(trained).to_bytes(4, "little") + trained)
        info = b"software: girder\r\nformat: WARC File Format 1.1\r\n"
        self._put(self.by.compress(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, info)))
        for data in held:
            self.add(data)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.by.compress(data))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"name": self.name, "records": self.records, "bytes": self.bytes}

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.path)


def frames(stream: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each frame of an archive but the dictionary's, which opens the others. One record is held at a time."""
    buffer, at = b"", 0

    def filled(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n and (more := stream.read(READ_BYTES)):
            buffer += more
        return len(buffer) >= n

    by = zstandard.ZstdDecompressor()
    while filled(1):
        if filled(8) and int.from_bytes(buffer[:4], "little") & 0xFFFFFFF0 == 0x184D2A50:
            magic, size = (int.from_bytes(buffer[i : i + 4], "little") for i in (0, 4))
            if not filled(8 + size):
                raise ValueError("the archive ends within a skippable frame")
            if at == 0 and magic == DICTIONARY_MAGIC:
                by = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(buffer[8 : 8 + size]))
            buffer, at = buffer[8 + size :], at + 8 + size
            continue
        frame, parts, used = by.decompressobj(), [], 0
        while True:
            if not filled(1):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(buffer))
            used += len(buffer) - len(frame.unused_data)
            buffer = frame.unused_data
            if frame.eof:
                break
        yield at, used, b"".join(parts)
        at += used


def indexed(fs: pa.fs.FileSystem, path: str, name: str, payloads: bool) -> Iterator[dict]:
    """A row for each response and revisit of an archive; payload digests are those of the payloads read, and must be those stated."""
    with fs.open_input_stream(path) as stream:
        for offset, length, data in frames(stream):
            fields, block = parsed(data)
            kind = fields["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            method, _, stated = fields.get("warc-payload-digest", "").partition(":")
            stated = base64.b32decode(stated).hex() if method == "sha1" else None
            payload = None
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                found = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                if stated is not None and found != stated:
                    raise ValueError(f"{name} at {offset}: payload digest {found}, stated {stated}")
                stated = found
            row_id, refers = fields.get("x-row-id"), fields.get("warc-refers-to")
            row = {"id": int(row_id) if row_id is not None else None, "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_digest": stated, "payload_bytes": len(payload) if payload is not None else None, "refers_to": refers and refers.strip("<>"), "archive": name, "offset": offset, "length": length}
            yield row | {"payload": payload} if payloads else row


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    fs, root = pa.fs.FileSystem.from_uri(path)
    return fs, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    archives: list[dict] = field(default_factory=list)


@dataclass
class Part(InputPartition):
    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class WarcZst(DataSource):
    """Archives in a folder. Rows to write: ``ROWS``; rows read: ``INDEX``, with ``payload binary`` where the option payloads is true."""

    @classmethod
    def name(cls) -> str:
        return "warczst"

    def schema(self) -> str:
        return INDEX + (", payload binary" if self._payloads() else "")

    def _payloads(self) -> bool:
        return str(self.options.get("payloads", "false")).lower() == "true"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)), int(self.options.get("sampleBytes", SAMPLE_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self._payloads(), schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, sample_bytes: int):
        self.path, self.file_bytes, self.sample_bytes = path, file_bytes, sample_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(self.path)
        fs.create_dir(folder)
        done, archive, held, size = [], None, [], 0
        open_now: list[Archive] = []
        try:
            for data in (x for batch in iterator for x in records(batch)):
                if archive is None:
                    held.append(data)
                    size += len(data)
                    if size < self.sample_bytes:
                        continue
                    open_now.append(archive := Archive(fs, folder, held))
                    held, size = [], 0
                else:
                    archive.add(data)
                if archive.bytes >= self.file_bytes:
                    done.append(archive.close())
                    archive = None
            if held:
                open_now.append(archive := Archive(fs, folder, held))
            if archive is not None:
                done.append(archive.close())
        except BaseException:
            for archive in open_now:
                archive.drop()
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.path)
        fs.create_dir(folder)
        listed = {x["name"]: x for m in messages if m for x in m.archives} | {x["name"]: x for x in committed(fs, folder) or []}
        with fs.open_output_stream(f"{folder}/{LIST}.new") as out:
            out.write("".join(json.dumps(x) + "\n" for _, x in sorted(listed.items())).encode())
        fs.move(f"{folder}/{LIST}.new", f"{folder}/{LIST}")
        for x in fs.get_file_info(pa.fs.FileSelector(folder)):
            if x.base_name.endswith(".warc.zst") and x.base_name not in listed:
                fs.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.path)
        for x in (x for m in messages if m for x in m.archives):
            fs.delete_file(f"{folder}/{x['name']}")


def committed(fs: pa.fs.FileSystem, folder: str) -> list[dict] | None:
    if fs.get_file_info(f"{folder}/{LIST}").type != pa.fs.FileType.File:
        return None
    with fs.open_input_stream(f"{folder}/{LIST}") as stream:
        return [json.loads(x) for x in stream.read().decode().splitlines()]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, schema):
        self.path, self.payloads, self.columns = path, payloads, schema

    def partitions(self) -> list[InputPartition]:
        fs, folder = _open(self.path)
        listed = committed(fs, folder)
        if listed is None:  # archives that others have written
            listed = [{"name": x.base_name} for x in fs.get_file_info(pa.fs.FileSelector(folder)) if x.base_name.endswith(".warc.zst")]
        return [Part(x["name"]) for x in listed] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.name:
            return
        fs, folder = _open(self.path)
        schema, rows, size = to_arrow_schema(self.columns), [], 0
        for row in indexed(fs, f"{folder}/{partition.name}", partition.name, self.payloads):
            rows.append(row)
            size += 200 + len(row.get("payload") or b"")
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def records(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The records of a batch of ``ROWS``, one at a time."""
    ids, urls, payloads, digests, kinds, refers = (batch.column(x) for x in ("id", "url", "payload", "payload_digest", "record_type", "refers_to"))
    for i in range(batch.num_rows):
        row_id, url, digest, kind = ids[i].as_py(), urls[i].as_py(), digests[i].as_py(), kinds[i].as_py()
        headers = {"WARC-Target-URI": url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url), "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "X-Row-Id": None if row_id is None else str(row_id)}
        if kind == "revisit":
            yield record("revisit", f"urn:uuid:{uuid.uuid4()}", headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_urn(refers[i].as_py(), digest)}>"}, b"")
        else:
            payload = payloads[i].as_py()
            named = record_urn(row_id, digest) if len(payload) >= LEAST_BYTES else f"urn:uuid:{uuid.uuid4()}"
            yield record("response", named, headers | {"Content-Type": "application/http;msgtype=response"}, HTTP + payload)


def with_types(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``ROWS``: each page as the response of its payload or as a revisit of it; revisits carry no payload."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    large = F.octet_length("payload") >= LEAST_BYTES
    each = rows.where(large).groupBy("payload_digest", "id").agg(F.count("*").alias("n"))
    first = each.groupBy(F.col("payload_digest").alias("__digest")).agg(F.max(F.struct("id", "n")).alias("__first"), F.sum("n").alias("__all")).where("__all > 1")
    first = scratch.save(first, "first")
    met = rows.join(first, (F.col("payload_digest") == F.col("__digest")) & large, "left")
    is_first = F.col("id").eqNullSafe(F.col("__first.id"))
    ties = F.col("__all").isNotNull() & is_first & (F.col("__first.n") > 1)
    first_of = F.lit(0).cast("long")
    met = met.withColumn("__copy", first_of)
    if not is_empty(first.where("__first.n > 1")):
        tied = numbered(met.where(ties).drop("__copy"), "payload_digest", scratch, "tied", "__copy")
        met = met.where(~ties).unionByName(tied.select(met.columns))
    revisit = F.col("__all").isNotNull() & ~(is_first & (F.col("__copy") == 0))
    return met.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first.id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, sample_bytes: int = SAMPLE_BYTES, **columns: str) -> None:
    """Archives of all pages in a folder that driver and executors share; further calls add to it."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcZst)
    rows = with_types(pages, Scratch(spark, "op11"), **columns)
    rows.write.format("warczst").option("fileBytes", file_bytes).option("sampleBytes", sample_bytes).mode("append").save(folder)


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The index of all archives of a folder, with each record's place; ``payloads``: and what it holds."""
    spark.dataSource.register(WarcZst)
    return spark.read.format("warczst").option("payloads", str(payloads).lower()).load(folder)


def resolved(index: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to id): revisits with what their response holds, nulls if it is in no archive."""
    responses = index.where("record_type = 'response'")
    targets = responses.where(f"payload_bytes >= {LEAST_BYTES}").select(F.col("record_id").alias("__record"), F.col("id").alias("__id"), F.col("payload_bytes").alias("__bytes"))
    revisits = index.where("record_type = 'revisit'").join(targets, F.col("refers_to") == F.col("__record"), "left")
    none = F.lit(None).cast("long")
    return responses.select("id", "payload_bytes", "payload_digest", "record_type", none.alias("refers_to")).unionByName(revisits.select("id", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("__id").alias("refers_to")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op11")
    write(table(spark, sf_dir, "pages"), f"{scratch.path}/archives")
    index = scratch.save(read(spark, f"{scratch.path}/archives"), "index")
    return resolved(index).withColumnRenamed("id", "page_id")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC) AS k, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND k > 1 THEN top END AS refers_to
FROM p
"""
