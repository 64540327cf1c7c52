"""WARC archives written and read back as a table of chunks.

Writing: Spark cuts each payload into rows of ``chunk`` bytes, in their order,
and knows its digest and length; a task streams the rows through one compressor
to one archive file, so no record is put together in Python's memory.  Each
record is a gzip member of its own, so a reader can start at any.  A record
whose payload equals that of a later page is a revisit of it: it has no payload
and names the record that it refers to, but keeps its HTTP header and digest.

Files are named with the partition and a random part, and a task hands over an
index row for each record once its file is closed.  The index is cut by a
reliable checkpoint, so it names just the files of the attempts that counted;
files of lost attempts are never read.

Reading: (record identifier, chunk number, bytes, digest) rows.  The SHA-1 of
the payload is carried from chunk to chunk, so each row has the digest and
length of the payload up to and with itself, and the last has that of all; a
record never stands in memory as a whole, whatever its length.  ``digests``
folds these rows: a record's last chunk, checked against the sum of its chunks,
and for a revisit those of the record that it refers to.

Identifiers: that of a page's response follows from its page_id, so that others
can refer to it; any other record's is random.

Defined cases: a null payload is empty; empty payloads are payloads like others;
of equal payloads the record with the largest page_id is the response (each row
of it, where rows repeat: then with one identifier and one payload), a null
page_id counts as the smallest; where all have a null page_id each is a
response; a null url is empty; an empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.checkpoints import folder
from ledgerloom.llm.common import column, cut, mapped

CHUNK = 1 << 20
LEVEL = 1
#: Payloads met more than once go to the writers as a broadcast up to this number (about 60 bytes each), else by a salted join.
BROADCAST_PAYLOADS = 500_000
SALTS = 32

INDEX = "file string, start long, length long, page_id long"
CHUNKS = "record_id string, file string, start long, page_id long, url string, record_type string, refers_to long, refers_to_record string, chunk_no long, data binary, bytes_so_far long, digest_so_far string, last boolean, header_digest string, header_bytes long"


_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")


def record_id(page: int) -> str:
    """The identifier of a page's response."""
    return f"urn:uuid:{uuid.uuid5(_NAMES, str(page))}"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def deduplicated(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to names the page with the same payload and the largest id, or is null."""
    body = F.coalesce(column(payload).cast("string"), F.lit(""))
    rows = pages.select(column(id).cast("long").alias("page_id"), F.coalesce(column(url).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    again = (
        rows.where(F.octet_length("payload") >= least).select("page_id", "digest").groupBy("digest")
        .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1 and newest is not null").select("digest", "newest")
    )
    again = cut(again)
    if again.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS:
        rows = rows.join(F.broadcast(again), "digest", "left")
    else:
        spread = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "salt"], "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))


def write(pages: DataFrame, target: str, chunk: int | None = None, **options) -> DataFrame:
    """Writes one record for each page below ``target`` (any URI of pyarrow's file systems) and returns the index of the records."""
    size_ = chunk or CHUNK
    size, kept = F.octet_length("payload").cast("long"), F.col("refers_to").isNull()
    records = deduplicated(pages, **options).withColumn("size", size)
    last = F.when(kept & (F.col("size") > 0), F.ceil(F.col("size") / size_) - 1).otherwise(0).cast("int")
    body = F.when(kept, F.substring(F.col("payload").cast("binary"), F.col("k") * size_ + 1, F.lit(size_))).otherwise(F.lit(b""))
    pieces = records.withColumn("k", F.explode(F.sequence(F.lit(0), last))).select("page_id", "url", "refers_to", "digest", "size", "k", body.alias("data"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, path = FileSystem.from_uri(target)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, packer, at, index = None, None, 0, []
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            for page, url, ref, digest, size, k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == 0:
                    _ended(out, packer)
                    packer, at = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), out.tell()
                    index.append((f"{target}/{name}", at, page))
                    out.write(packer.compress(_head(page, url, ref, _b32(bytes.fromhex(digest)), size)))
                out.write(packer.compress(data))
        _ended(out, packer)
        end = out.tell() if out is not None else 0
        if out is not None:
            out.close()
        files, starts, ids = zip(*index, strict=True) if index else ([], [], [])
        sizes = [b - a for a, b in zip(starts, [*starts[1:], end], strict=True)] if index else []
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["file", "start", "length", "page_id"])

    return cut(mapped(pieces, task, INDEX))


def _ended(out, packer) -> None:  # noqa: ANN001
    """Writes the end of the record that is open, if one is."""
    if packer is not None:
        out.write(packer.compress(b"\r\n\r\n") + packer.flush())


def _head(page: int | None, url: str, ref: int | None, digest: str, size: int) -> bytes:
    """The headers of a record and of the response in it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    own = record_id(page) if ref is None and page is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if ref is None else 'revisit'}", f"WARC-Record-ID: <{own}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page is None else page}"]
    if ref is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(ref)}>", f"X-Refers-To-Page-ID: {ref}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if ref is None else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


def _inflated(source, start: int, length: int, chunk: int) -> Iterator[bytes]:  # noqa: ANN001
    """The bytes of one member, in pieces of at most chunk."""
    source.seek(start)
    unpacker = zlib.decompressobj(31)
    while length and not unpacker.eof:
        data = source.read(min(length, chunk))
        length -= len(data)
        if not data:
            raise EOFError("archive ends within a record")
        while data and not unpacker.eof:
            yield unpacker.decompress(data, chunk)
            data = unpacker.unconsumed_tail
    while not unpacker.eof and (more := unpacker.decompress(b"", chunk)):
        yield more


def _parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The header fields of a record, then its payload in pieces."""
    held = b""
    for piece in pieces:
        held += piece
        if b"\r\n\r\n" in held and b"\r\n\r\n" in held.split(b"\r\n\r\n", 1)[1]:
            break
    head, http, held = held.split(b"\r\n\r\n", 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields["http-length"] = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]
    yield fields, None
    left = int(fields["Content-Length"]) - len(http) - 4
    while left:
        if held:
            yield fields, held[:left]
            left -= len(held[:left])
        held = next(pieces) if left else b""


def read(index: DataFrame, chunk: int | None = None) -> DataFrame:
    """The chunks of the indexed records (``CHUNKS``)."""
    names = [x.strip().split()[0] for x in CHUNKS.split(",")]
    size_ = chunk or CHUNK
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[x.strip().split()[1]] for x in CHUNKS.split(",")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        rows, held, now, source = [], 0, None, None

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for file, start, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if file != now:
                    if source is not None:
                        source.close()
                    system, path = FileSystem.from_uri(file)
                    now, source = file, system.open_input_file(path)
                parts = _parsed(_inflated(source, start, length, size_))
                fields, _ = next(parts)
                page, ref = (int(x) if (x := fields.get(k)) else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                ids = [x.strip("<>") if (x := fields.get(k)) else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                base = (ids[0], file, start, page, fields.get("WARC-Target-URI", ""), fields["WARC-Type"], ref, ids[1])
                tail = (fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["http-length"]))
                digest, done, k = hashlib.sha1(usedforsecurity=False), 0, 0
                piece = next(parts, None)
                while True:  # an empty payload is one empty chunk
                    body = piece[1] if piece else b""
                    digest.update(body)
                    done += len(body)
                    piece = next(parts, None) if piece else None
                    rows.append((*base, k, body, done, _b32(digest.digest()), not piece, *tail))
                    held += len(body) + 300
                    k += 1
                    if held >= 4 * CHUNK:
                        yield made()
                        rows.clear()
                        held = 0
                    if not piece:
                        break
        if source is not None:
            source.close()
        yield made()

    return mapped(index.select("file", "start", "length"), task, CHUNKS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the folder that the cluster shares."""
    return f"{folder(spark.sparkContext)}/warc-{uuid.uuid4().hex}"


def digests(chunks: DataFrame) -> DataFrame:
    """One row for each record, of its full payload as read: the last chunk's, or for a revisit those of the record that it refers to.

    A record whose chunks do not add up to what its last one says, or to what
    its header says, has null figures.
    """
    last = F.max(F.struct("chunk_no", "bytes_so_far", "digest_so_far", "last")).alias("end")
    base = ["record_id", "file", "start", "page_id", "record_type", "refers_to", "refers_to_record", "header_digest", "header_bytes"]
    records = chunks.groupBy(*base).agg(last, F.sum(F.octet_length("data")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    response = F.col("record_type") == "response"
    whole = F.col("end.last") & (F.col("end.chunk_no") == F.col("n") - 1) & (F.col("end.bytes_so_far") == F.col("bytes"))
    whole = whole & (~response | ((F.col("bytes") == F.col("header_bytes")) & (F.col("end.digest_so_far") == F.col("header_digest"))))
    records = cut(records.select("record_id", "page_id", "record_type", "refers_to", "refers_to_record", "header_digest", F.when(whole, F.col("bytes")).alias("bytes"), F.when(whole, F.col("end.digest_so_far")).alias("digest")))
    full = records.where(response).groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max(F.struct("bytes", "digest")).alias("full"))
    both = records.where(~response).join(cut(full), "refers_to_record", "left")
    revisits = both.select("page_id", F.col("full.bytes").alias("payload_bytes"), F.when(F.col("full.digest") == F.col("header_digest"), F.col("header_digest")).alias("payload_digest"), "record_type", "refers_to")
    return records.where(response).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to").union(revisits)
