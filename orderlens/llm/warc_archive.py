"""Dictionary-compressed web archives: pages as WARC records, each its own Zstandard frame.

A dictionary is built from records of a bounded sample (``sample_rows`` pages by the least hash,
``sample_bytes`` of each) and stands, itself compressed, in a skippable frame at the head of
every archive, so that an archive can be read with nothing else at hand. Behind it each record
is a frame compressed with that dictionary. A sample too small to train on (an empty table, a
handful of tiny pages) gives archives without dictionary and without leading frame.

Of the pages with equal payloads (by SHA-1 and length) of ``least`` bytes or more, the one with
the largest page_id is written whole as a ``response``; the others become ``revisit`` records
that name it. The largest id per payload is a partial aggregate of narrow rows; pages meet it in
one join that Spark splits where a payload is hot, and are written within its tasks. An archive
ends after ``archive_bytes``. Tasks write under names of their own attempt and return a manifest
of what they wrote; only the saved manifest counts, so a repeated or lost task leaves files that
nobody reads. Reading starts from the archives named there, decodes frame after frame and checks
each payload against its digest.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other; rows
that share payload, largest page_id and thus the claim are all responses; a null url is left out
of the record; characters that no URI may hold are percent-encoded, and read back as such; an
empty table gives no archive and an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import emit, place, prepare, saved
from orderlens.session import staging_dir

# Fixed values of the archive formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_ROWS = 512
SAMPLE_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 28
LEVEL = 3
CHUNK = 1 << 20
# Rows of one Arrow batch of pages.
PAGES = 64
DATE = "1970-01-01T00:00:00Z"

MANIFEST = pa.schema(
    [("archive", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]
)
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
SAFE = "!#$&'()*+,/:;=?@[]~-._%"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str | None
    payload: bytes | None  # None in a revisit
    payload_bytes: int
    payload_digest: str
    refers_to: int | None = None

    @property
    def record_type(self) -> str:
        return "revisit" if self.payload is None else "response"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}').urn}>"


def encode(record: Record) -> bytes:
    """The record's bytes: WARC header, HTTP header, payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record.payload_bytes}\r\n\r\n".encode()
    block = http + (record.payload or b"")
    fields = {
        "WARC-Type": record.record_type,
        "WARC-Record-ID": record_id(record.page_id, record.payload_digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if record.url is None else quote(record.url, safe=SAFE),
        "WARC-Payload-Digest": f"sha1:{record.payload_digest}",
        "WARC-Page-ID": record.page_id,
        "Content-Type": "application/http; msgtype=response",
    }
    if record.payload is None:
        fields |= {
            "WARC-Profile": REVISIT_PROFILE,
            "WARC-Refers-To": record_id(record.refers_to, record.payload_digest),
            "WARC-Refers-To-Page-ID": record.refers_to,
        }
    head = [VERSION, *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}


def decode(data: bytes) -> Record:
    """The record of ``encode``; a payload that does not fit its digest is an error."""
    head, rest = data.split(b"\r\n\r\n", 1)
    if not head.startswith(VERSION.encode()):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, payload = block.split(b"\r\n\r\n", 1)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload that its digest does not fit")
    number = {k: int(fields[k]) if k in fields else None for k in ("warc-page-id", "warc-refers-to-page-id")}
    return Record(
        number["warc-page-id"],
        fields.get("warc-target-uri"),
        None if revisit else payload,
        int(_fields(http)["content-length"]),
        digest,
        number["warc-refers-to-page-id"],
    )


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or no bytes where the sample is too small for one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def head_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def frames(stream) -> Iterator[bytes]:
    """The decompressed frames of an archive, read in chunks: memory holds one record."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        packed = stream.read(struct.unpack("<I", head[4:])[0])
        raw = zstandard.ZstdDecompressor().decompress(packed) if packed.startswith(ZSTD_MAGIC) else packed
        dictionary, head = zstandard.ZstdCompressionDict(raw), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = head
    while rest := rest or stream.read(CHUNK):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise ValueError("an archive that ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


class Archives:
    """Archives of one task, one after the other, each begun with the dictionary."""

    def __init__(self, folder: str, dictionary: bytes, level: int, most: int):
        self.files, self.folder = place(folder)
        self.uri, self.most, self.head = folder, most, head_frame(dictionary)
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=made)
        self.stream, self.name, self.size = None, "", 0

    def write(self, record: bytes) -> tuple[str, int, int]:
        """Archive, place and length of the record's frame."""
        if self.stream is None or self.size >= self.most:
            self.close()
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.files.create_dir(self.folder, recursive=True)
            self.stream = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.stream.write(self.head)
            self.size = len(self.head)
        packed = self.packer.compress(record)
        self.stream.write(packed)
        start, self.size = self.size, self.size + len(packed)
        return f"{self.uri}/{self.name}", start, len(packed)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def narrow(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long")})


def claims(rows: DataFrame, least: int) -> DataFrame:
    """Per payload that several pages have, and that is long enough: the largest page_id."""
    alike = rows.where(F.col("size") >= least).groupBy("digest", "size")
    return alike.agg(F.max("page_id").alias("claim"), F.count("*").alias("n")).where("n > 1").drop("n")


def dictionary_of(rows: DataFrame, sample_rows: int, sample_bytes: int, size: int) -> bytes:
    """Trained on the ``sample_rows`` pages of the least hashes. A share of all hashes that holds
    about four times as many keeps the ordering small."""
    order = F.shiftrightunsigned(F.xxhash64("digest", "page_id"), 11)
    share = min(1.0, 4 * sample_rows / max(1, rows.count()))
    sample = rows.where(order <= int(share * (1 << 53))).select(
        order.alias("order"), "page_id", "url", F.substring("payload", 1, sample_bytes).alias("payload"), "digest", "size"
    )
    found = sample.orderBy("order", "page_id", "url").limit(sample_rows).collect()  # sample_rows * sample_bytes at most
    return train([encode(Record(r.page_id, r.url, bytes(r.payload), r.size, base32(r.digest))) for r in found], size)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 0,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """Write the archives into ``folder`` (one that driver and executors share) and return the saved
    manifest: archive, page_id, record_type, start and length of each record's frame."""
    spark = prepare(pages.sparkSession)
    rows = narrow(pages, id_col, url_col, html_col)
    dictionary = dictionary_of(rows, sample_rows, sample_bytes, dictionary_bytes)
    claimed = rows.join(claims(rows, least), ["digest", "size"], "left")
    whole = F.col("claim").isNull() | F.col("page_id").eqNullSafe(F.col("claim"))
    records = claimed.select("page_id", "url", F.when(whole, F.col("payload")).alias("payload"), "size", "digest", "claim")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder, dictionary, level, archive_bytes)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, PAGES):
                    lines = []
                    for page_id, url, payload, size, digest, claim in zip(*(c.to_pylist() for c in batch.slice(start, PAGES).columns), strict=True):
                        record = Record(page_id, url, payload, size, base32(digest), claim if payload is None else None)
                        name, at, length = archives.write(encode(record))
                        lines.append((name, page_id, record.record_type, at, length))
                    if lines:
                        yield emit(MANIFEST, *zip(*lines, strict=True))
        finally:
            archives.close()

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES))
    try:
        return saved(records.mapInArrow(written, "archive string, page_id long, record_type string, start long, length long"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives named in column ``archive``: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and, if asked for, payload (null in a revisit)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = place(name)
                with files.open_input_stream(path, compression=None) as stream:
                    lines, held = [], 0
                    for data in frames(stream):
                        r = decode(data)
                        payload = r.payload if with_payload else None
                        lines.append((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, payload))
                        held += len(payload or b"") + 1
                        if len(lines) == 4096 or held > 1 << 24:
                            yield emit(RECORDS, *zip(*lines, strict=True))
                            lines, held = [], 0
                    if lines:
                        yield emit(RECORDS, *zip(*lines, strict=True))

    names = archives.select("archive").distinct()
    # One archive is a task's work: as many partitions as archives, which AQE leaves alone.
    spread = names.repartition(max(1, names.count()))
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    found = spread.mapInArrow(each, kinds)
    return found if with_payload else found.drop("payload")


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the session's shared folder and read them back."""
    folder = f"{staging_dir(prepare(pages.sparkSession))}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, **options))


def _oracle() -> str:
    """Bare SHA-1 as SQL: five hexadecimal digits are four base32 characters."""
    value = "('0x' || substr(h, 1 + 5 * (k // 4), 5))::INT"
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({value} >> (15 - 5 * (k % 4))) & 31)::INT, 1)"
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS claim FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: {letter}), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM claim THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM claim THEN claim END AS refers_to
FROM r"""


ORACLE = _oracle()
