"""WARC archives: written with an index of byte ranges first, read back through it.

Each record is its own gzip member, so that a record is read by its byte range alone. Selected
records of an archive are read in order of offset, ranges that lie close together in one read.
An archive's name has the task attempt in it and only the attempt that Spark accepts is in the index,
so a task that runs again does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskey.llm.scratch import Tables, new_path, send_package

#: Ranges of one read: at most so far apart, and so many bytes together (one record at least).
GAP = 64 << 10
READ = 4 << 20
#: Bytes of an archive that one task reads, about.
SPAN = 64 << 20
#: Tasks that pages of one payload are dealt to.
SALTS = 16
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(x: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in x)


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> tuple[bytes, str]:
    """(one WARC record, payload digest); a revisit of page ``refers_to`` if that isn't None."""
    digest = digest_of(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    head.append(f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{page_id}'}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        block = b""
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(record: bytes) -> tuple[dict[str, str], bytes | None]:
    """(headers, payload; None for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, None if headers["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]


def _write(folder: str, date: str):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        out = None
        at = 0
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                record, digest = make_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, date)
                member = gzip.compress(record, 4, mtime=0)
                out.write(member)
                rows.append((page_id, url, name, at, len(member), digest))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate((batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["page_id", "url", "archive", "offset", "length", "payload_digest"],
            )
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns the index: page_id, url, archive, offset, length, payload_digest.

    Of rows with equal payloads of ``min_bytes`` or more, that with the largest id is a response and the
    others revisit it; rows that repeat that id with that payload are responses too. Rows without an id
    count as smallest and are all responses where no row of their payload has an id. A null payload is empty; a null
    url is written as urn:page:<id>. The index is a written table, so archives are written once.
    """
    spark = pages.sparkSession
    send_package(spark)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.sha1(F.encode("html", "utf-8"))))
    again = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 and latest is not null").drop("n")
    # A payload that very many pages have, as the empty one, is dealt to several tasks.
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = again.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    judged = keyed.join(again, ["key", "salt"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to"))
    kind = rows.schema["page_id"].dataType.simpleString()
    index = judged.mapInArrow(_write(folder, date), f"page_id {kind}, url string, archive string, offset long, length long, payload_digest string")
    return Tables(spark).write(index, "warc-index")


def _ranges(rows: list[tuple[str, int, int]]):
    """Rows in order of archive and offset, as runs that one read covers."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > READ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _read(batches):
    from pyarrow import fs

    opened = (None, None)
    for batch in batches:
        rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for part in _ranges(rows):
            if opened[0] != part[0][0]:
                store, path = fs.FileSystem.from_uri(part[0][0])
                opened = (part[0][0], store.open_input_file(path))
            first = part[0][1]
            data = opened[1].read_at(part[-1][1] + part[-1][2] - first, first)
            out = []
            for _, offset, length in part:
                headers, payload = parse_record(zlib.decompress(data[offset - first : offset - first + length], 31))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if payload is not None and digest_of(payload) != digest:
                    raise ValueError(f"{part[0][0]} at {offset}: the payload does not have its digest")
                page, other = (headers.get(h) for h in ("Page-Id", "Refers-To-Page-Id"))
                out.append((page, headers["WARC-Target-URI"], headers["WARC-Type"], other, digest, None if payload is None else len(payload), None if payload is None else payload.decode("utf-8", "replace")))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def read_archives(index: DataFrame, spread: int | None = None) -> DataFrame:
    """Records that ``index`` selects (rows of what ``write_archives`` returned): page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Payloads are checked against their digests. A revisit has no payload of its own; ``resolve_revisits`` gives it its length.
    """
    spark = index.sparkSession
    send_package(spark)
    n = spread or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // 4096))
    kind = index.schema["page_id"].dataType.simpleString()
    # A task gets spans of archives; few records are selected from far more bytes as cheaply as many.
    dealt = index.select("archive", "offset", "length").repartition(n, "archive", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("archive", "offset")
    fields = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload string"
    read = dealt.mapInArrow(_read, fields)
    return read.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's length is that of the response it refers to."""
    own = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    lengths = own.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("full"))
    return own.join(lengths, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
