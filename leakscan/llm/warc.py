"""WARC archives in Zstandard: one frame per record behind a dictionary in a leading skippable frame.

Archives are written by Spark's text writer, so the job's commit protocol makes them whole on any file
system it knows. Its line separator is an empty skippable frame, which Zstandard readers pass over.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

#: Magic number of the skippable frame that holds the dictionary, and of an empty one between records.
DICTIONARY = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
FRAME = b"\x28\xb5\x2f\xfd"
#: Payloads this long may be revisits.
REVISIT_BYTES = 100
SAMPLE_PAGES = 400
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 32 << 20
SALTS = 32
#: Of an archive, given to the decoder at a time.
PART_BYTES = 16 << 10


class BadArchive(ValueError):
    """The archive or one of its records is not valid."""


# --- records ------------------------------------------------------------------------------------


def _head(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "".join(f"\r\n{k}: {v}" for k, v in fields) + "\r\n\r\n").encode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A WARC/1.1 response or revisit record; a revisit keeps the HTTP head only."""
    block = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    named = lambda x: f"<urn:page:{'' if x is None else x}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", named(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", named(refers_to))]
    else:
        block += payload
    return _head("WARC/1.1", [*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    out = {}
    for x in lines:
        k, colon, v = x.partition(":")
        if not colon or not k or k != k.strip():
            raise BadArchive(f"not a header: {x[:60]!r}")
        if k.lower() in out:
            raise BadArchive(f"{k} twice")
        out[k.lower()] = v.strip()
    return first, out


def _number(fields: dict[str, str], name: str) -> int:
    v = fields.get(name, "")
    if not v.isascii() or not v.isdigit():
        raise BadArchive(f"{name}: {v[:40]!r}")
    return int(v)


def parse(data: bytes) -> dict:
    """A record's columns; raises BadArchive if a header, a length or the payload's digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive("no end of headers")
    version, w = _fields(head)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"version {version[:20]!r}")
    for k in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if k not in w:
            raise BadArchive(f"no {k}")
    n = _number(w, "content-length")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {n}, but {len(rest) - 4} bytes")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    status, h = _fields(http)
    if not gap or not status.startswith("HTTP/"):
        raise BadArchive("no HTTP head")
    size, kind, digest = _number(h, "content-length"), w["warc-type"], w["warc-payload-digest"].removeprefix("sha256:")
    refers = None
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("the payload's length or digest is wrong")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in w:
            raise BadArchive("a revisit with a payload or without what it refers to")
        refers, payload = w["warc-refers-to"], None
    else:
        raise BadArchive(f"type {kind[:20]!r}")
    number = lambda x: (lambda s: int(s) if s.lstrip("-").isdigit() else None)(x.removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": number(w["warc-record-id"]), "url": w.get("warc-target-uri"), "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else number(refers)}


# --- archives -----------------------------------------------------------------------------------


def _decoder(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def frames(data: bytes):
    """The records of one archive: the dictionary comes first, then a frame each; other skippable frames are passed over."""
    view, at, decoder = memoryview(data), 0, None
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if len(view) - at < 8:
            raise BadArchive("a cut frame")
        if magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F:
            size = struct.unpack("<I", view[at + 4 : at + 8])[0]
            if at + 8 + size > len(view):
                raise BadArchive("a cut skippable frame")
            if at == 0:
                if struct.unpack("<I", magic)[0] != DICTIONARY:
                    raise BadArchive("the first frame holds no dictionary")
                own = bytes(view[8 : 8 + size])
                decoder = _decoder(zstandard.ZstdDecompressor().decompress(own) if own.startswith(FRAME) else own)
            at += 8 + size
            continue
        if magic != FRAME:
            raise BadArchive(f"no frame at byte {at}")
        if decoder is None:
            decoder = _decoder(b"")
        stream, out, to = decoder.decompressobj(), [], at
        # a frame's length is not known before its end: fed in parts, no more than a part is read beyond it
        while not stream.eof:
            if to >= len(view):
                raise BadArchive("a cut frame")
            try:
                out.append(stream.decompress(view[to : to + PART_BYTES]))
            except zstandard.ZstdError as e:
                raise BadArchive(f"frame at byte {at}: {e}") from e
            to = min(len(view), to + PART_BYTES)
        at = to - len(stream.unused_data)
        yield b"".join(out)


def train_dictionary(pages: DataFrame, html: str) -> bytes:
    """A dictionary from the distinct payloads (their first 16 KB) of least hash, about SAMPLE_PAGES of them; b'' where there are too few."""
    long = pages.where(F.octet_length(html) >= REVISIT_BYTES).select(F.xxhash64(html).alias("o"), html)
    n = long.agg(F.approx_count_distinct("o")).first()[0]
    # the hash's share of its range is the payloads' share: only what is used leaves its task
    chosen = long.where(F.col("o") <= min(2**63 - 1, int(SAMPLE_PAGES / max(1, n) * 2**64) - 2**63))
    rows = chosen.groupBy("o").agg(F.first(F.substring(F.encode(html, "UTF-8"), 1, 16384)).alias("x")).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r.x) for r in sorted(rows)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def plan(pages: DataFrame, partitions: int, id: str = "page_id", html: str = "html") -> DataFrame:
    """`pages` in `partitions` partitions with _digest, _refers and _revisit: of equal payloads of at least REVISIT_BYTES the smallest id is
    the response, the other rows revisit it. Rows that share the smallest id are all responses; null ids are largest.

    Digests are counted before they are shuffled, and the join back is salted, so one common payload is no task's whole load.
    The join's partitions are the archives', so payloads are shuffled once.
    """
    data = F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))
    own = pages.withColumn("_digest", F.sha2(data, 256)).withColumn("_salt", F.pmod(F.xxhash64(id, "url"), F.lit(SALTS)).cast("int"))
    long = F.coalesce(F.octet_length(html), F.lit(0)) >= REVISIT_BYTES
    least = own.where(long).groupBy("_digest").agg(F.min(id).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _least is not null")
    least = least.select(F.col("_digest").alias("_d"), "_least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    own, least = own.repartition(partitions, "_digest", "_salt"), least.repartition(partitions, "_d", "_s")
    out = own.join(least, (F.col("_digest") == F.col("_d")) & (F.col("_salt") == F.col("_s")), "left")
    again = F.col("_least").isNotNull() & ~F.col(id).eqNullSafe(F.col("_least"))
    return out.withColumn("_revisit", again).withColumn("_refers", F.when(again, F.col("_least"))).drop("_d", "_s", "_salt", "_least")


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives of about ARCHIVE_BYTES of payload each under `path`, a record per row; null html is an empty payload."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    dictionary = train_dictionary(pages, "html")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    def run(batches):
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer, first = zstandard.ZstdCompressor(level=3, dict_data=own), True
        for batch, _ in C.slices(batches, "html"):
            out = [struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary] if first and dictionary else []
            first = False
            for i, u, x, digest, revisit, refers in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "_digest", "_revisit", "_refers")), strict=True):
                out.append(packer.compress(record(i, u, b"" if x is None else x.encode(), digest, refers, revisit)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    n = max(1, -(-total // ARCHIVE_BYTES))
    records = plan(pages, n).mapInArrow(run, "value binary")
    # bytes pass a string cast as they are, and the text writer writes them as they are
    records.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under `path`: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to. Raises if an archive is not valid. Empty archives hold no records."""
    schema = T.StructType(
        [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())]
    )
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for x in frames(data.as_py()):
                    rows.append(parse(x))
                    size += len(x)
                    if size > C.SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content").mapInArrow(run, schema)
