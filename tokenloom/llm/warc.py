"""Deterministic sharded WARC writer and reader.

Records are sorted by page_id over ranges, whose cuts depend on the page_ids alone; each range is written into
files of its own, each closed once its compressed size reaches a limit. A record is a gzip member of its own, with headers and digests made from the
page alone, so that the same pages give the same bytes. Files appear under temporary names and are renamed
when complete; the manifest, written last, names the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import READERS, filesystem, id_cuts, new_folder, range_of, stage

#: Compressed bytes from which a file is closed.
FILE_BYTES = 256 << 20
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
#: Bytes of payloads in a range, about.
RANGE_BYTES = 64 << 20
#: WARC-Date of all records: the writer is deterministic, so the time of writing isn't recorded.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SALTS = 32


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """The URL without characters that would break a header line."""
    return re.sub(r"[\x00-\x20\x7f-￿\U00010000-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record, a response or (refers_to given, with that page's URL) a revisit, before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url, page_id)}", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{sha1}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        target = [f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url, refers_to)}"]
        head += [f"WARC-Profile: {_PROFILE}", *target, f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    """A gzip member without a time or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(raw: bytes) -> dict:
    """Page, type, digest and payload size of a record; its digests are checked against its content."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page-ID"))}


def records_of(stream, chunk: int = 1 << 20, step: int = 1 << 14, seen=None):
    """The records of a file, one gzip member at a time; seen(bytes) is told of everything read."""
    z, out = zlib.decompressobj(31), []
    while read := stream.read(chunk):
        if seen:
            seen(read)
        view, at = memoryview(read), 0
        while at < len(view):
            some = view[at : at + step]  # few bytes, as what lies behind a member's end is copied
            out.append(z.decompress(some))
            at += len(some) - len(z.unused_data)
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the file ends within a record")


def _write(folder: str, file_bytes: int):
    names = ["part", "seq", "file", "records", "bytes", "sha256"]

    def run(batches):
        part, seq = None, 0
        fs, base = filesystem(folder)
        fs.create_dir(base)
        out = temporary = hasher = None
        count = size = 0
        key, target, target_url = None, None, None  # the copy that the last marker row was about, and what it refers to
        written = None

        def closed():
            nonlocal out, seq
            out.close()
            name = f"pages-{part:06d}-{seq:05d}.warc.gz"
            fs.move(temporary, f"{base}/{name}")
            out, seq = None, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq - 1, name, count, size, hasher.hexdigest())], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    own = (row["page_id"], row["digest"])
                    if row["range"] != part:
                        if out is not None:
                            yield closed()
                        part, seq = row["range"], 0
                    if row["kind"] == 0:
                        key, target, target_url = own, row["refers_to"], row["refers_url"]
                        continue
                    refers_to = target if own == key else None
                    if refers_to is not None and refers_to == row["page_id"] and written != own:
                        refers_to = None  # the first of equal rows is the response
                    written = own
                    if out is None:
                        temporary, hasher, count, size = f"{base}/.{uuid.uuid4().hex}", hashlib.sha256(), 0, 0
                        out = fs.open_output_stream(temporary, compression=None)
                    raw = _gzip(record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], refers_to, target_url))
                    out.write(raw)
                    hasher.update(raw)
                    count, size = count + 1, size + len(raw)
                    if size >= file_bytes:
                        yield closed()
        if out is not None:
            yield closed()

    return run, "part long, seq long, file string, records long, bytes long, sha256 string"


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> None:
    """Writes pages(page_id, url, html) as WARC files and a manifest into folder.

    A null html is an empty payload; a null url gets the target URI urn:page:<page_id>. Of pages with equal
    payloads of LEAST_REVISIT bytes or more, the one with the smallest page_id (null ones never) is the
    response and the others are revisits that refer to it; of rows with the same page_id and payload the
    first by url is the response. An empty table gives a manifest without rows; other columns are ignored,
    whatever their names. The same rows give the same files, however they are partitioned; the rows of one
    page_id lie in one range.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html"), 256))
    # who refers to whom, on narrow rows; hot payloads are combined before the shuffle and salted in the join
    keys = stage(rows.where(f"octet_length(html) >= {LEAST_REVISIT} and page_id is not null").select("page_id", "url", "digest"), "digests")
    first = keys.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stage(first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "first-copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    marks = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")).join(first, ["digest", "salt"]).select("page_id", "digest", "refers_to", "refers_url").distinct()
    # marker rows travel just before their pages, so that pages are shuffled once only
    marks = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(0).alias("kind"), "refers_to", "refers_url")
    both = rows.withColumns({"kind": F.lit(1), "refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}).unionByName(marks)
    # a range lies whole in one task, whichever that is, and its files are named after it
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    cuts = id_cuts(rows.select(F.col("page_id").alias("id")), n, -(-(size or 0) // range_bytes))
    run, schema = _write(f"{folder}/files", file_bytes)
    files = both.withColumn("range", range_of(cuts)("page_id")).repartitionByRange("range").sortWithinPartitions("range", "page_id", "digest", "kind", "url").mapInArrow(run, schema)
    files.write.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files in the manifest; digests of records and files are checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        fs, base = filesystem(f"{folder}/files")
        for batch in batches:
            for file, records, digest in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "sha256"))):
                rows, count, whole = [], 0, hashlib.sha256()
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for raw in records_of(stream, seen=whole.update):
                        rows.append(parse_record(raw))
                        count += 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if (count, whole.hexdigest()) != (records, digest):
                    raise ValueError(f"{file} is not the file of the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    manifest = spark.read.schema("part long, seq long, file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    # a task for each file, at most READERS; a given number of ranges is not coalesced
    files = manifest.count()
    dealt = manifest.select("file", "records", "sha256").repartitionByRange(max(1, min(READERS, files)), "file")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archives(pages: DataFrame) -> DataFrame:
    """Writes pages to the shared folder as archives and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
r AS (SELECT *, payload_bytes >= {LEAST_REVISIT} AND page_id <> first_id AS again FROM m)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
