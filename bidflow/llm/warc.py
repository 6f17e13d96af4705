"""Operator 6, WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key and written to archives, one gzip member per record. The
index keeps sorted captures in compressed blocks and, above them, a sparse directory with the first and
last key of each block. A lookup searches the directory, then a block, and reads only a byte range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.shared import join_groups, pieces, table, text_of
from bidflow.operators.sizing import scratch_folder

#: Payloads below this size are always written in full.
REVISIT_BYTES = 100
BLOCK_CAPTURES = 500
READ_BYTES = 4 << 20
ARCHIVE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url):
    """The host's labels from the last to the first, then the rest of the URL: com,example,www)/path?query.

    Scheme, port and user are left out, a line feed becomes %0A; text without a host is kept as it is; null is the empty key.
    """
    url = F.replace(F.coalesce(url, F.lit("")), F.lit("\n"), F.lit("%0A"))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    reversed_host = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    return F.when(host == "", url).otherwise(F.concat(reversed_host, F.lit(")"), F.regexp_replace(url, pattern, "")))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record. Fields that the format lacks start with X-."""
    body = HTTP_HEAD.encode() + (b"" if revisit else payload)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|")))
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    return head([*fields, ("Content-Length", len(body))]) + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of a record; a record that is cut short is an error."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError(f"record of {len(rest)} bytes instead of {n + 4}")
    return fields, rest[:n]


def packed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, wbits=31)
    return squeeze.compress(data) + squeeze.flush()


def write(pages: DataFrame, folder: str, archives: int | None = None) -> DataFrame:
    """Writes archives and index below a folder that all executors share; returns the index.

    pages: page_id, url, html (other columns are ignored; null html is an empty payload, null url the
    empty key). Of equal payloads of at least `REVISIT_BYTES` the smallest page_id is written as a response,
    the others as revisits of it; rows sharing page_id and payload are marked alike. Rows whose equals all
    lack a page_id are responses. Index: first_key, last_key, archive, captures, block (compressed lines
    key, offset, length). A task that is repeated writes a new archive; only those in the index count.
    """
    spark = pages.sparkSession
    rows = pages.select(url_key(F.col("url")).alias("key"), "page_id", "url", text_of("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    path = scratch_folder(spark, "captures")
    rows.select("key", "page_id", "digest", F.octet_length("html").cast("long").alias("size")).write.parquet(path)
    narrow = spark.read.schema("key string, page_id long, digest string, size long").parquet(path)
    groups = narrow.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 AND first_id IS NOT NULL")
    total = narrow.agg(F.count("*"), F.sum("size")).first()
    repeats = join_groups(narrow.select("key", "page_id", "digest"), groups, "digest", "n", total[0])
    # What a page repeats travels as a row of its own that sorts before the page, so payloads are shuffled once.
    notes = repeats.filter("NOT page_id <=> first_id").select("key", "page_id", "digest", "first_id").distinct()
    notes = notes.withColumns({"url": F.lit(None).cast("string"), "html": F.lit(""), "note": F.lit(True)})
    marked = rows.withColumns({"first_id": F.lit(None).cast("long"), "note": F.lit(False)}).unionByName(notes)
    count = archives or max(1, -(-(total[1] or 0) // ARCHIVE_BYTES), min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    root = f"{folder.rstrip('/')}/archives"

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        lines: list[tuple[str, int, int]] = []
        noted: dict[str, int] = {}
        place = None

        def block() -> pa.RecordBatch:
            text = "\n".join(f"{offset} {length} {key}" for key, offset, length in lines)
            values = [[lines[0][0]], [lines[-1][0]], [name], [len(lines)], [zlib.compress(text.encode(), 6)]]
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["first_key", "last_key", "archive", "captures", "block"])

        try:
            for batch in pieces(batches, "html"):
                for row in batch.to_pylist():
                    if place != (row["key"], row["page_id"]):
                        place = (row["key"], row["page_id"])
                        noted.clear()
                    if row["note"]:
                        noted[row["digest"]] = row["first_id"]
                        continue
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        info = b"software: warc writer\r\n"
                        opening = packed(head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")
                        out.write(opening)
                        at = len(opening)
                    first = noted.get(row["digest"])
                    data = packed(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], first, first is not None))
                    out.write(data)
                    lines.append((row["key"], at, len(data)))
                    at += len(data)
                    if len(lines) == BLOCK_CAPTURES:
                        yield block()
            if lines:
                yield block()
        finally:
            if out is not None:
                out.close()

    index = (
        marked.select("key", "page_id", "url", "digest", "first_id", "note", "html")
        .repartitionByRange(count, "key", "page_id").sortWithinPartitions("key", "page_id", F.desc("note"))
        .mapInArrow(archive, "first_key string, last_key string, archive string, captures long, block binary")
    )
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def read(index: DataFrame, folder: str, keys: list[str] | None = None, with_payload: bool = False) -> DataFrame:
    """Records of the archives through the index: all, or those of a list of URL keys (see `url_key`).

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload (null for revisits).
    The digest of each payload that is read is computed again and must equal the record's.
    """
    root = f"{folder.rstrip('/')}/archives"
    wanted = sorted({k.replace("\n", "%0A") for k in keys}) if keys is not None else None
    blocks = index.select("archive", "block")
    if wanted is not None:
        # The directory is searched on its two key columns before blocks are unpacked.
        @F.pandas_udf("boolean")
        def touched(first, last):
            import pandas as pd

            return pd.Series([bisect_left(wanted, a) < len(wanted) and wanted[bisect_left(wanted, a)] <= b for a, b in zip(first, last)], dtype=bool)

        blocks = index.filter(touched("first_key", "last_key")).select("archive", "block")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = [x.split(" ", 2) for x in zlib.decompress(block).decode().split("\n")]
                if wanted is not None:
                    sorted_keys, some = [x[2] for x in lines], []
                    low, high = bisect_left(wanted, sorted_keys[0]), len(wanted)
                    for key in wanted[low:high]:
                        if key > sorted_keys[-1]:
                            break
                        i = bisect_left(sorted_keys, key)
                        while i < len(lines) and sorted_keys[i] == key:
                            some.append(lines[i])
                            i += 1
                    lines = some
                spans = [(int(a), int(n)) for a, n, _ in lines]
                with store.open_input_file(f"{base}/{name}") as archive:
                    for run in runs(spans):
                        yield from records(archive.read_at(run[-1][0] + run[-1][1] - run[0][0], run[0][0]), run)

    def runs(spans: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        """Neighbouring records to be read at once."""
        run: list[tuple[int, int]] = []
        for at, n in spans:
            if run and (run[-1][0] + run[-1][1] != at or at + n - run[0][0] > READ_BYTES):
                yield run
                run = []
            run.append((at, n))
        if run:
            yield run

    def records(raw: bytes, run: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for at, n in run:
            fields, content = parsed(zlib.decompress(raw[at - run[0][0] :][:n], wbits=31))
            payload = content.partition(b"\r\n\r\n")[2]
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
            number = lambda k: int(fields[k]) if k in fields else None
            size = len(payload) if kind == "response" else number("X-Payload-Length")
            body = payload.decode() if with_payload and kind == "response" else None
            rows.append((number("X-Page-Id"), fields.get("WARC-Target-URI"), size, digest, kind, number("X-Refers-To-Page"), body))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return blocks.mapInArrow(extract, f"{CAPTURES}, payload string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "warc")
    return read(write(table(spark, sf_dir, "pages"), folder), folder).drop("url", "payload")


ORACLE_OP6 = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         g AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h, min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM p)
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
           CASE WHEN n < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM g"""
