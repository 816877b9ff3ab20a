"""Web archives (WARC): pages written as response, revisit and continuation records, and read back whole.

Each page's HTTP response has a chunked body. A block longer than a segment goes on in continuation records, which name the first record as their origin, their
number, and, in the last one, the block's whole length. Pages with a payload that a page of smaller id has are revisits without a body. Spark writes the archives (compressed text files whose line
separator is the blank lines that end a record) and lists them again, so any file system that Spark knows will do.

Reading parses each file by its records' lengths. Whole records are decoded where they are read; only segments are shuffled: grouped by origin,
put in order by number, held against the whole length and freed from chunk framing. A revisit then takes the payload's facts from the record that it refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, broadcast_if_small, cut_lineage, small_batches

END = "\r\n\r\n"
_FIELDS = "record_id string, record_type string, item_id long, url string, refers_id string, origin_id string, number int, total long, payload_bytes long, payload_digest string, complete boolean, payload binary, part binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(item_id: int | None, payload: bytes) -> str:
    """The same for each response with this id and payload, so that revisits can name it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{item_id} '.encode() + hashlib.sha256(payload).digest()).digest()[:16], version=5)}>"


def chunked(body: bytes, size: int) -> bytes:
    parts = []
    for lo in range(0, len(body), size):
        piece = body[lo : lo + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The body without its chunk framing; ValueError if that is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response; ValueError if its head or chunks are broken."""
    at = block.index(b"\r\n\r\n")
    head = block[:at].lower().split(b"\r\n")
    body = block[at + 4 :]
    return unchunked(body) if any(h.startswith(b"transfer-encoding:") and b"chunked" in h for h in head[1:]) else body


def _uri(url: str) -> str:
    """url without blanks and control characters, which can't stand in a field."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def page_records(item_id: int | None, url: str | None, payload: bytes, first: int | None, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit if first is another page's id, else a response and its continuations."""
    own = record_id(item_id, payload)
    revisit = first is not None and first != item_id
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + b"\r\n" if revisit else head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    pieces = [block[lo : lo + segment_bytes] for lo in range(0, len(block), segment_bytes)]
    shared = [f"WARC-Date: {date}"] + ([f"WARC-Target-URI: {_uri(url)}"] if url is not None else [])
    for number, piece in enumerate(pieces, 1):
        if number == 1:
            fields = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", *shared, f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
            fields += [f"Item-ID: {item_id}"] if item_id is not None else []
            fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, payload)}"] if revisit else []
        else:
            fields = ["WARC-Type: continuation", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {number}')}>", *shared, f"WARC-Segment-Origin-ID: {own}"]
        fields += [f"WARC-Segment-Number: {number}"] if len(pieces) > 1 else []
        fields += [f"WARC-Segment-Total-Length: {len(block)}"] if number == len(pieces) > 1 else []
        yield "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(piece)}", "", ""]).encode() + piece


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, segment_bytes: int = 16_384, chunk_bytes: int = 4096, date: str = "2000-01-01T00:00:00Z", records_per_file: int = 2000) -> None:
    """Writes a response or revisit record for every page, compressed, with at most records_per_file records a file.

    Of the pages with one payload of least_bytes at least, those with the smallest id are responses and the others revisit them; pages without an id
    come last (alone, all are responses). A null html is an empty payload; ids are cast to long.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    d = d.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    often = d.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select("key", "first")
    d = d.join(broadcast_if_small(cut_lineage(often)), "key", "left").select("id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                rows = batch.slice(lo, 100).to_pylist()
                records = list(chain.from_iterable(page_records(r["id"], r["url"], r["payload"], r["first"], date, segment_bytes, chunk_bytes) for r in rows))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])

    records = d.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(folder)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of an archive's records, compressed or not; a block that ends early is given as far as it goes."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content), 1 << 18)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t":  # a folded field
                fields[name] += " " + line.strip().decode()
            else:
                name, _, value = line.decode().partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _facts(block: bytes, keep_payload: bool) -> dict:
    try:
        payload = http_payload(block)
    except ValueError:
        return {"payload_bytes": None, "payload_digest": None, "complete": False, "payload": None}
    return {"payload_bytes": len(payload), "payload_digest": payload_digest(payload), "complete": True, "payload": payload if keep_payload else None}


def archive_records(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """Response, revisit and continuation records of a folder's files, one row each; blocks only of segments (part), payload facts only of whole responses."""
    small_batches(spark)
    schema = T.StructType.fromDDL(_FIELDS)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def row(fields: dict[str, str], block: bytes) -> dict:
        kind, number = fields.get("warc-type", ""), int(fields.get("warc-segment-number", 0))
        whole = len(block) == int(fields["content-length"])
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        out = {"record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_id": fields.get("warc-refers-to"), "origin_id": fields.get("warc-segment-origin-id")}
        out |= {"item_id": int(fields["item-id"]) if "item-id" in fields else None, "number": number or None, "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None}
        if number:
            return out | {"origin_id": out["origin_id"] or out["record_id"], "part": block, "payload_digest": digest}
        if kind == "response":
            return out | (_facts(block, keep_payload) if whole else {"complete": False})
        return out | {"payload_digest": digest, "complete": whole}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for fields, block in parse_records(content.as_py()):
                    if fields.get("warc-type") in ("response", "revisit", "continuation"):
                        rows.append(row(fields, block))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def reassembled(parts: DataFrame, keep_payload: bool = False) -> DataFrame:
    """(record_id, payload_bytes, payload_digest, complete, payload) of segmented records, from their segments (origin_id, number, total, part).

    A record is complete if its segments are numbered without gaps, add up to the whole length that the last one states, and hold sound chunks. Segments that repeat
    an origin and number count once.
    """
    one = parts.groupBy("origin_id", "number").agg(F.max("total").alias("total"), F.first("part").alias("part"))
    sized = F.sum(F.length("part").cast("long")).alias("bytes")
    whole = one.groupBy("origin_id").agg(F.max("total").alias("total"), F.count("*").alias("n"), F.max("number").alias("last"), sized, F.array_sort(F.collect_list(F.struct("number", "part"))).alias("parts"))
    ok = F.coalesce((F.col("n") == F.col("last")) & (F.col("bytes") == F.col("total")), F.lit(False))
    fields = [T.StructField("record_id", T.StringType()), *[f for f in T.StructType.fromDDL(_FIELDS) if f.name in ("payload_bytes", "payload_digest", "complete", "payload")]]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                origin, good, pieces = (batch.column(k)[i].as_py() for k in range(3))
                facts = _facts(b"".join(pieces), keep_payload) if good else {"complete": False}
                yield pa.RecordBatch.from_pylist([{"record_id": origin} | facts], arrow)

    return whole.select("origin_id", ok.alias("ok"), F.transform("parts", lambda p: p["part"]).alias("parts")).mapInArrow(run, T.StructType(fields))


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """(record_id, record_type, item_id, url, payload_bytes, payload_digest, refers_to, complete, payload) of each response and revisit record.

    payload_bytes, payload_digest (bare base32 SHA-1) and payload are those of the full payload, for a revisit of the record that it refers to, whose item_id is refers_to. What can't be put
    together or decoded has complete false and null facts (a revisit keeps the digest that it states). Records that repeat an id count as often as they stand there. A
    segmented record's parts meet in one row, as its payload does. A folder without records gives no rows.
    """
    scratch = Scratch(spark)
    records = scratch.keep("records", archive_records(spark, folder, keep_payload))
    heads = records.filter("record_type <> 'continuation'")
    facts = ["payload_bytes", "payload_digest", "complete", "payload"]
    joined = reassembled(records.filter("part is not null"), keep_payload)
    own = ["record_id", "record_type", "item_id", "url", "refers_id"]
    split = heads.filter("part is not null").select(*own).join(joined, "record_id", "left").select(*own, *[F.coalesce("complete", F.lit(False)).alias(c) if c == "complete" else c for c in facts])
    whole = heads.filter("part is null").select(*own, *facts)
    answers = cut_lineage(whole.filter("record_type = 'response'").unionByName(split.filter("record_type = 'response'")))
    again = whole.filter("record_type = 'revisit'").unionByName(split.filter("record_type = 'revisit'"))
    by_id = cut_lineage(answers.groupBy("record_id").agg(F.max(F.struct("complete", "payload_bytes", F.col("payload_digest").alias("digest"), F.col("item_id").alias("refers_to"), "payload")).alias("a")))
    # The sides are dealt for this join alone, so Spark can split a response that very many records revisit.
    seen = again.withColumnsRenamed({"complete": "sound", "payload_digest": "stated"}).drop("payload_bytes", "payload").join(by_id.withColumnRenamed("record_id", "refers_id"), "refers_id", "left")
    good = F.coalesce(F.col("sound") & F.col("a.complete") & (F.col("stated") == F.col("a.digest")), F.lit(False))
    revisits = seen.select("record_id", "record_type", "item_id", "url", F.when(good, F.col("a.payload_bytes")).alias("payload_bytes"), F.col("stated").alias("payload_digest"), F.col("a.refers_to").alias("refers_to"), good.alias("complete"), F.when(good, F.col("a.payload")).alias("payload"))
    responses = answers.select("record_id", "record_type", "item_id", "url", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"), "complete", "payload")
    out = cut_lineage(responses.unionByName(revisits))
    scratch.drop()
    return out


def archive_digest(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, written to archives in the shared folder, read back and removed."""
    scratch = Scratch(pages.sparkSession)
    write_archives(pages, f"{scratch.folder}/archives")
    back = read_archives(pages.sparkSession, f"{scratch.folder}/archives")
    scratch.drop()
    return back.select(F.col("item_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_sql() -> str:
    return """
with p as (select page_id, coalesce(html, '') h from pages),
f as (select *, min(page_id) over (partition by h) first from p),
b as (select *, list_transform(range(20), lambda i: instr('0123456789abcdef', lower(substr(sha1(h), (2 * i + 1)::int, 1))) * 16 + instr('0123456789abcdef', lower(substr(sha1(h), (2 * i + 2)::int, 1))) - 17) o from f)
select page_id, strlen(h)::bigint payload_bytes,
array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((o[(5 * k) // 8 + 1] * 256 + coalesce(o[(5 * k) // 8 + 2], 0)) // (1 << (11 - (5 * k) % 8)::int)) % 32)::int, 1)), '') payload_digest,
case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to from b"""
