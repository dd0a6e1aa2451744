"""WARC archives as dictionary-compressed Zstandard files.

A file starts with a skippable frame that holds a Zstandard dictionary; every record follows as a frame of its
own, compressed with that dictionary, so that a record can be read by its offset alone. The dictionary
is trained once on a bounded sample of the records' own bytes, drawn by a hash of the page id.

Each task rolls over files of bounded size and returns their names. Names hold a random part, so a repeated
task never touches what an earlier attempt wrote, and only returned names are read back.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from datetime import datetime, timezone
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.llm.work import written

SKIPPABLE = 0x184D2A5D
ROLL_BYTES = 64 << 20
STAMP = datetime(1970, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
FILES = "file string"
READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, stored_bytes long")


def _place(folder: str):
    """(file system, path) of a folder given as a URI or a plain path."""
    return pafs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (pafs.LocalFileSystem(), folder)


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def _clean(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", str(value))


def record(page, url, payload: bytes, length: int, digest: str, refers) -> bytes:
    """One WARC record; a revisit carries no payload but its full length and digest."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {STAMP}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {length}"]
    head += [f"X-Page-ID: {page}"] * (page is not None)
    head += [f"WARC-Target-URI: {_clean(url)}"] * (url is not None)
    if refers is not None:
        head += [f"WARC-Refers-To: {_record_id(refers)}", f"X-Refers-To-Page-ID: {refers}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        head.append("Content-Type: text/html; charset=utf-8")
    body = payload if refers is None else b""
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the content block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError(f"record of {size} bytes holds {len(rest) - 4}")
    return fields, rest[:size]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; for samples too few to train on, the samples themselves as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _train(batches, size: int):
    samples = [x for b in batches for x in b.column("record").to_pylist()]
    if samples:
        yield pa.RecordBatch.from_pydict({"dictionary": [_dictionary(samples, size)]})


class _Writer:
    """One archive after another in a folder."""

    def __init__(self, folder: str, dictionary: bytes, level: int, roll: int) -> None:
        self.fs, self.path = _place(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.raw, self.roll, self.names, self.out = dictionary, roll, [], None
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.names.append(f"{uuid.uuid4().hex}.warc.zst")
            self.out = self.fs.open_output_stream(f"{self.path}/{self.names[-1]}", compression=None)
            self.out.write(struct.pack("<II", SKIPPABLE, len(self.raw)) + self.raw)
        self.out.write(self.codec.compress(data))
        if self.out.tell() >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _write(batches, folder: str, dictionary: bytes, level: int, roll: int):
    writer = _Writer(folder, dictionary, level, roll)
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
        for i in range(batch.num_rows):
            page, url, payload, size, digest, refers = (c[i].as_py() for c in columns)
            writer.add(record(page, url, payload or b"", size, digest, refers))
    writer.close()
    yield pa.RecordBatch.from_pydict({"file": pa.array(writer.names, pa.string())})


def records(fs, path: str):
    """(parsed record, stored bytes) of an archive, one frame at a time."""
    with fs.open_input_stream(path, compression=None) as source:
        head = source.read(8)
        magic, size = struct.unpack("<II", head)
        if magic != SKIPPABLE:
            raise ValueError(f"{path} does not start with a dictionary frame")
        raw = source.read(size)
        words = zstandard.ZstdCompressionDict(raw) if raw else None
        codec, rest = zstandard.ZstdDecompressor(dict_data=words), b""
        while True:
            rest = rest or source.read(1 << 20)
            if not rest:
                return
            frame, stored, parts = codec.decompressobj(), 0, []
            while True:
                parts.append(frame.decompress(rest))
                stored += len(rest)
                if frame.eof:
                    break
                rest = source.read(1 << 20)
                if not rest:
                    raise ValueError(f"{path} ends inside a record")
            rest = frame.unused_data
            yield parse(b"".join(parts)), stored - len(rest)


def _read(batches, folder: str):
    fs, path = _place(folder)
    names = READ.replace(",", "").split()[::2]
    for batch in batches:
        for file in batch.column("file").to_pylist():
            rows, held = [], 0
            for (f, body), stored in records(fs, f"{path}/{file}"):
                response = f["warc-type"] == "response"
                digest = f["warc-payload-digest"].partition(":")[2]
                if response and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"digest of a record in {file} differs")
                number = lambda k: int(f[k]) if k in f else None
                rows.append((number("x-page-id"), f.get("warc-target-uri"),
                             len(body) if response else number("x-payload-length"), digest, f["warc-type"],
                             number("x-refers-to-page-id"), stored))
                held += 1
                if held % 5000 == 0:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def write_archives(pages: DataFrame, folder: str, least: int = 100, dictionary_bytes: int = 64 << 10,
                   sample_records: int = 500, sample_bytes: int = 8 << 10, level: int = 3,
                   roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html) below ``folder``; returns the file names.

    Of the records with equal payloads of ``least`` bytes or more, the one with the smallest page id is a
    response and the others revisit it. Rows that repeat that page id are responses too; a row with a null
    page id is a response and is never referred to. A null html is an empty payload. An empty table
    writes no file. Other columns are not read. The dictionary is trained on the first
    ``sample_bytes`` of ``sample_records`` records.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("payload_bytes"),
                       F.sha2("payload", 256).alias("payload_digest"))
    repeated = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()) \
        .groupBy(F.col("payload_digest").alias("d")) \
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    marked = rows.join(repeated, (F.col("payload_digest") == F.col("d")) & (F.col("page_id") > F.col("first")), "left") \
        .withColumn("refers_to", F.col("first"))
    marked = marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    record_bytes = F.udf(lambda p, u, d: record(p, u, bytes(d), len(d), "0" * 64, None), "binary")
    sample = rows.where("payload_bytes > 0").select("page_id", "url", F.expr(f"substring(payload, 1, {sample_bytes})").alias("d")) \
        .orderBy(F.xxhash64("page_id"), "page_id").limit(sample_records)
    trained = sample.select(record_bytes("page_id", "url", "d").alias("record")) \
        .coalesce(1).mapInArrow(partial(_train, size=dictionary_bytes), "dictionary binary").collect()
    dictionary = bytes(trained[0].dictionary) if trained else b""
    return written(marked.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
                   .mapInArrow(partial(_write, folder=folder, dictionary=dictionary, level=level, roll=roll_bytes), FILES),
                   "manifest")


def read_archives(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The records of the named files: ids, payload size and digest, type, and what a revisit refers to."""
    spread = files.repartition(max(1, min(files.count(), spark.sparkContext.defaultParallelism * 4)))
    return spread.mapInArrow(partial(_read, folder=folder), READ)
