"""WARC archives: an index of the written records first, then coalesced byte-range reads of the selected ones."""

from __future__ import annotations

from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path, tidy

#: The base32 alphabet (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Largest count of repeated payloads sent to every executor (about 40 bytes each); beyond it a shuffle join is used.
BROADCAST_REPEATS = 500_000
END = "\r\n\r\n"
BLANK = END.encode()
INDEX = ["shard", "offset", "length", "key", "url", "digest", "size", "record_type", "refers_to"]


def base32_sha1(digits: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal: 40 digits are 8 groups of four letters."""
    letters = []
    for i in range(8):
        v = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _head(kind: Column, key: Column, url: Column, digest: Column, size: Column, refers: Column) -> tuple[Column, Column]:
    """The WARC header up to and including its blank line, and the HTTP header that starts the block."""
    nl = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), size.cast("string"), F.lit(nl + nl))
    block = F.octet_length(http) + F.when(kind == "response", size).otherwise(0)

    def urn(key: Column) -> Column:
        return F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(key)), F.lit("")), F.lit(">"))

    head = F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: "), kind, F.lit(f"{nl}WARC-Record-ID: "), urn(key),
        F.lit(f"{nl}WARC-Date: 1970-01-01T00:00:00Z{nl}WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "%0A"),
        F.lit(f"{nl}WARC-Payload-Digest: sha1:"), digest,
        F.when(kind == "revisit", F.concat(F.lit(f"{nl}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{nl}WARC-Refers-To: "), urn(refers))).otherwise(F.lit("")),
        F.lit(f"{nl}Content-Type: application/http; msgtype=response{nl}Content-Length: "), block.cast("string"), F.lit(nl + nl),
    )
    return head, http


def _key_of(urn: str | None) -> str | None:
    """The id in a record's address; null for the address of a record without one."""
    return unquote_plus(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page>" else None


def _open(path: str, name: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(f"{path if '://' in path else 'file://' + path}/{name}")
    return store.open_input_file(at)


def _entries(stream, window: int = 1 << 20):
    """(offset, length, header fields, payload bytes) of the records of one archive file, read forward; payloads that
    reach beyond the bytes at hand are skipped and never held whole."""
    total, at, base, data = stream.size(), 0, 0, b""
    while at < total:
        size = window
        while True:
            start = at - base
            head = data.find(BLANK, start) if start < len(data) else -1
            http = data.find(BLANK, head + len(BLANK)) if head >= 0 else -1
            if http >= 0:
                break
            if base == at and base + len(data) >= total:
                raise ValueError("no WARC record at this offset")
            base, data = at, stream.read_at(min(size, total - at), at)
            size *= 2
        fields = _fields(data[start:head])
        length = head + len(BLANK) - start + int(fields[b"Content-Length"])
        payload = _fields(data[head + len(BLANK) : http])[b"Content-Length"]
        yield at, length, fields, int(payload)
        at += length + len(END)


def index_warc(path: str, key_type: T.DataType) -> DataFrame:
    """The index of an archive: shard (file), offset, length, key, url, digest, size, record_type, refers_to per record.

    It is made from the files as they were written, so it holds however the tasks that wrote them were dealt or retried.
    """
    spark = SparkSession.active()
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("shard"))

    def run(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                rows = []
                with _open(path, shard) as stream:
                    for offset, length, f, size in _entries(stream):
                        refers = f.get(b"WARC-Refers-To")
                        rows.append((shard, offset, length, _key_of(f[b"WARC-Record-ID"].decode()), f[b"WARC-Target-URI"].decode(), f[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), size, f[b"WARC-Type"].decode(), _key_of(refers and refers.decode())))
                        if len(rows) == 10_000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=INDEX)

    out = files.mapInArrow(tidy(run), "shard string, offset long, length long, key string, url string, digest string, size long, record_type string, refers_to string")
    return materialize(out.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type)), "warc-index")


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, path: str | None = None) -> tuple[str, DataFrame]:
    """Write a record per row; returns the archive's folder and its index (see ``index_warc``).

    Payloads are not shuffled: each task of the scan writes its records as one file by the text writer, whose line
    separator is the record separator. Among records with equal payloads (SHA-1 and size) of at least ``min_bytes`` bytes
    the one with the smallest id is a response and the others revisit it; repeated rows with that smallest id are all
    responses. A null payload is empty, a null url is written as an empty one, rows with null ids are written (and are
    responses when no id in their class is known). An empty table gives an empty index; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("sha1", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    repeats = base.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null").drop("copies")
    repeats = materialize(repeats, "warc-repeats")
    if repeats.count() <= BROADCAST_REPEATS:
        repeats = F.broadcast(repeats)
    df = base.join(repeats, ["sha1", "size"], "left")
    kind = F.when(F.col("first").isNull() | F.col("key").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    df = df.withColumn("record_type", kind).withColumn("refers_to", F.when(kind == "revisit", F.col("first")))
    head, http = _head(F.col("record_type"), F.col("key").cast("string"), F.col("url"), base32_sha1(F.col("sha1")), F.col("size"), F.col("refers_to").cast("string"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    df.select(F.concat(head.cast("binary"), http.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", END).text(path)
    return path, index_warc(path, pages.schema[id_col].dataType)


def read_warc(path: str, index: DataFrame, gap: int = 1 << 16, block: int = 4 << 20) -> DataFrame:
    """Read the records that ``index`` selects.

    Rows are sorted by shard and offset; ranges closer than ``gap`` are read together, up to ``block`` bytes at a time.
    Returns the index columns with the payload (empty for a revisit) and what the record's own headers say: h_type,
    h_digest, h_refers_to. A range that doesn't hold a record raises an error. An empty index gives no rows.
    """
    shards = max(1, index.sparkSession.sparkContext.defaultParallelism * 2)
    src = index.repartition(shards, F.col("shard"), F.floor(F.col("offset") / (4 * block))).sortWithinPartitions("shard", "offset")

    def run(batches):
        opened, stream = None, None
        for b in batches:
            shard, offset, length = (b.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(shard):
                j, last = i + 1, offset[i] + length[i]
                while j < len(shard) and shard[j] == shard[i] and offset[j] - last <= gap and offset[j] + length[j] - offset[i] <= block:
                    last = max(last, offset[j] + length[j])
                    j += 1
                if opened != shard[i]:
                    if stream is not None:
                        stream.close()
                    opened, stream = shard[i], _open(path, shard[i])
                data = stream.read_at(last - offset[i], offset[i])
                rows = [_parse(data[offset[k] - offset[i] : offset[k] - offset[i] + length[k]]) for k in range(i, j)]
                payload, kind, digest, refers = zip(*rows)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(kind), pa.array(digest), pa.array(refers, pa.string())], names=[*part.schema.names, "payload", "h_type", "h_digest", "h_refers_to"])
                i = j

    schema = T.StructType([*src.schema.fields, *T.StructType.fromDDL("payload binary, h_type string, h_digest string, h_refers_to string").fields])
    return src.mapInArrow(tidy(run), schema)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(x.partition(b": ")[::2] for x in head.split(b"\r\n")[1:])


def _parse(record: bytes) -> tuple[bytes, str, str, str | None]:
    head, _, block = record.partition(BLANK)
    if not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("no WARC record at this offset")
    fields = _fields(head)
    if int(fields[b"Content-Length"]) != len(block):
        raise ValueError("a record's length differs from its header")
    refers = fields.get(b"WARC-Refers-To")
    return block.partition(BLANK)[2], fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), _key_of(refers and refers.decode())
