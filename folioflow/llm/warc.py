"""Web archives as tables of chunks: written as WARC 1.1 by Spark's own writers, and read back in splits.

A record is rows of (record id, chunk number). A payload of up to ``CHUNK`` bytes is one chunk; of an oversized payload, windows of the column's
own buffer are cut off one after the other, each with the digest of all up to and including it, so that no copy of the whole payload is made, and chunks leave in
batches of bounded size. In the archive the first chunk is the record and each further chunk a continuation record (segment number, origin's id), as the format provides; a
reader can take any number of tasks to it, and a record is put together by streaming its sorted chunks through one digest, which is held against the one
each chunk carries. A chunk lost, swapped or altered is an error.

Archives are lines to Spark: each record ends with an empty line, as the format asks, and the reader splits files at the version line with which every
record begins. That line never stands inside a record: a chunk that would hold it is cut after its first letter.

Of records with equal payloads of at least ``SAME_BYTES`` bytes the one with the least page id is the response, the others revisit it (ties on the id go by
url). Payloads stay where they are: only rows that a Bloom filter of repeated digests lets through move, and of each group one payload a task. A revisit record holds
no payload, only its digest, length and what it refers to.

Nulls: a null page is an empty payload; null ids come last and are written as none, null urls first. Repeated rows are records of their own: a page that
repeats with its payload revisits itself if the payload is large enough, else it is a response again. Small repeated payloads are all responses. Texts of any length stay
whole. Line ends in urls are written as percent signs and numbers. Other columns are ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bitfilter
from folioflow.plans.materialize import shared_dir, spill

#: Fixed values of the format.
VERSION, END_OF_LINE, END_OF_RECORD = "WARC/1.1", "\r\n", "\r\n\r\n"
CHUNK = 1 << 20
SAME_BYTES = 100
SHIP_BYTES = 4 << 20
WRITTEN_AT = "2024-01-01T00:00:00Z"

_META = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_to_record string"
CHUNKS = _META + ", chunk_no int, last boolean, chunk string, digest_so_far string"
RECORDS = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_META_ARROW = [
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("refers_to", pa.int64()), ("refers_to_record", pa.string()),
]
_CHUNKS_ARROW = pa.schema([*_META_ARROW, ("chunk_no", pa.int32()), ("last", pa.bool_()), ("chunk", pa.string()), ("digest_so_far", pa.string())])
_RECORDS_ARROW = pa.schema([*[f for f in _META_ARROW if f[0] in ("record_id", "page_id", "url", "record_type")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_MARK = re.compile(rb"WARC/1\.1(\r\n|\Z)")


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A name for a record, the same in every run."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, copy.cast("string"), F.coalesce(F.concat(F.lit("u"), url), F.lit("-"))))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _order() -> Column:
    """Among equal payloads the least of these is the response."""
    return F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url"))


def records(pages: DataFrame, max_bits: int = bitfilter.MAX_BITS) -> DataFrame:
    """What is to be written of ``pages`` (page_id, url, html): responses with their payload, revisits without."""
    payload = F.coalesce("html", F.lit(""))
    full = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).select("*", _sha(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    thin = spill(full.drop("payload"), "warc-pages")
    large = thin.filter(F.col("payload_bytes") >= SAME_BYTES)
    groups = spill(large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(_order()).alias("first")).filter("n > 1"), "warc-groups")
    bits = bitfilter.bits_for(groups.count(), max_bits)
    bloom = spill(bitfilter.present(groups.select("payload_digest"), bits), "warc-filter")
    sent = bitfilter.probe(full, bloom, F.col("payload_digest"), bits, "maybe").withColumn("small", F.col("payload_bytes") < SAME_BYTES)

    straight = sent.filter("NOT maybe AND NOT small").withColumn("copy", F.lit(0))
    one_each = sent.filter("maybe AND NOT small").groupBy("payload_digest").agg(F.min_by(F.struct("page_id", "url", "payload", "payload_bytes"), _order()).alias("r"))
    again = sent.filter("small").groupBy("page_id", "url", "payload", "payload_digest", "payload_bytes").count()
    wanted = ["page_id", "url", "payload", "payload_digest", "payload_bytes", "copy"]
    responses = (
        straight.select(*wanted).unionByName(one_each.select("r.*", "payload_digest", F.lit(0).alias("copy")).select(*wanted))
        .unionByName(again.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")))).select(*wanted))
    )
    none = F.lit(None)
    responses = responses.select(
        _record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("copy")).alias("record_id"), "page_id", "url", F.lit("response").alias("record_type"),
        "payload_digest", "payload_bytes", none.cast("long").alias("refers_to"), none.cast("string").alias("refers_to_record"), "payload",
    )
    # a row of a group is a revisit but for the first; equal rows are counted, and told apart by their number
    repeats = large.groupBy("payload_digest", "payload_bytes", "page_id", "url").agg(F.count("*").cast("int").alias("copies"))
    met = repeats.join(groups.select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "payload_digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    at = F.when(is_first, F.when(F.col("copies") > 1, F.sequence(F.lit(1), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))
    revisits = met.withColumn("copy", F.explode(at)).select(
        _record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("copy")).alias("record_id"), "page_id", "url", F.lit("revisit").alias("record_type"),
        "payload_digest", "payload_bytes", F.col("first_id").alias("refers_to"),
        _record_id(F.col("first_id"), F.col("first_url"), F.col("payload_digest"), F.lit(0)).alias("refers_to_record"), F.lit("").alias("payload"),
    )
    return responses.unionByName(revisits)


def chunked(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of records: oversized payloads, and those that hold the version line, pass through Python in windows."""
    meta = [c for c in found.columns if c != "payload"]
    odd = (F.octet_length("payload") > chunk) | F.contains("payload", F.lit(VERSION))
    whole = found.filter(~odd).select(*meta, F.lit(1).alias("chunk_no"), F.lit(True).alias("last"), F.col("payload").alias("chunk"), F.lit(None).cast("string").alias("digest_so_far"))
    cut = found.filter(odd).select(*meta, "payload").mapInArrow(lambda batches: _cut(batches, chunk), CHUNKS)
    return whole.unionByName(cut)


def pieces(payload: memoryview, chunk: int = CHUNK) -> Iterator[bytes]:
    """A UTF-8 payload in windows of at most ``chunk`` bytes, cut between characters and inside every version line."""
    start, n = 0, len(payload)
    while start < n:
        end = min(n, start + chunk)
        while end < n and end > start + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        piece = bytes(payload[start:end])
        if mark := _MARK.search(piece):
            piece = piece[: mark.start() + 1]
        yield piece
        start += len(piece)


def _cut(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunk rows of bounded batches: at most SHIP_BYTES and one chunk more are held."""
    rows, held = [], 0
    for batch in batches:
        payloads = batch.column("payload")
        for meta, payload in zip(batch.drop_columns(["payload"]).to_pylist(), payloads, strict=True):
            view, digest, at = memoryview(payload.as_buffer()), hashlib.sha256(), 0
            for number, piece in enumerate(pieces(view, chunk), 1):
                digest.update(piece)
                at += len(piece)
                rows.append(meta | {"chunk_no": number, "last": at == len(view), "chunk": piece.decode(), "digest_so_far": digest.hexdigest()})
                held += len(piece) + 500
                if held > SHIP_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS_ARROW)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS_ARROW)


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END_OF_LINE)), F.lit(""))


def as_text(chunks: DataFrame) -> DataFrame:
    """Each chunk as one archive record, without the empty line after it."""
    first, split = F.col("chunk_no") == 1, ~(F.col("last") & (F.col("chunk_no") == 1))
    when = lambda condition, value: F.when(condition, value)
    url = F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(VERSION), F.lit("WARC/1%2E1"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END_OF_RECORD))
    block = F.when(first, F.concat(http, "chunk")).otherwise(F.col("chunk"))
    own_id = F.when(first, F.col("record_id")).otherwise(F.concat("record_id", F.lit("-"), F.col("chunk_no").cast("string")))
    header = F.concat(
        F.lit(VERSION + END_OF_LINE),
        _field("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        _field("WARC-Record-ID", _urn(own_id)),
        _field("WARC-Date", F.lit(WRITTEN_AT)),
        _field("WARC-Target-URI", url),
        _field("X-Page-ID", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _field("X-Payload-Length", F.col("payload_bytes")),
        _field("X-Refers-To-Page-ID", when(first, F.col("refers_to"))),
        _field("WARC-Refers-To", when(first, _urn(F.col("refers_to_record")))),
        _field("WARC-Segment-Number", when(split, F.col("chunk_no"))),
        _field("WARC-Segment-Origin-ID", when(~first, _urn(F.col("record_id")))),
        _field("WARC-Segment-Total-Length", when(split & F.col("last"), F.char_length(http) + F.col("payload_bytes"))),
        _field("X-Digest-So-Far", F.concat(F.lit("sha256:"), "digest_so_far")),
        _field("Content-Type", when(first, F.lit("application/http; msgtype=response"))),
        _field("Content-Length", F.octet_length(block)),
        F.lit(END_OF_LINE),
    )
    return chunks.select(F.concat(header, block).alias("value"))


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK, compression: str = "none", **options) -> None:
    """Write the archive of ``pages`` into the folder ``path``: one file a task, committed by Spark's writer."""
    as_text(chunked(records(pages, **options), chunk)).write.option("lineSep", END_OF_RECORD).option("compression", compression).text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of an archive. A record whose length isn't the one its header gives is an error."""
    lines = spark.read.option("lineSep", VERSION + END_OF_LINE).text(path).filter("value <> ''")
    head = F.substring_index("value", END_OF_RECORD, 1)
    rows = lines.select(F.str_to_map(head, F.lit(END_OF_LINE), F.lit(": ")).alias("h"), F.expr(f"substring(value, instr(value, '{END_OF_RECORD}') + 4, char_length(value) - instr(value, '{END_OF_RECORD}') - 7)").alias("block"))
    field = lambda name: F.col("h")[name]
    bare = lambda name: F.regexp_extract(field(name), "<urn:uuid:([^>]*)>|sha256:(.*)", 1)
    digest = lambda name: F.substring_index(field(name), ":", -1)
    first = field("WARC-Type") != "continuation"
    whole = F.when(F.octet_length("block") == field("Content-Length").cast("long"), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record "), field("WARC-Record-ID")))
    )
    number = F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1))
    rows = rows.withColumn("block", whole)
    return rows.select(
        F.when(first, bare("WARC-Record-ID")).otherwise(bare("WARC-Segment-Origin-ID")).alias("record_id"), field("X-Page-ID").cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        F.when(first, field("WARC-Type")).alias("record_type"), digest("WARC-Payload-Digest").alias("payload_digest"), field("X-Payload-Length").cast("long").alias("payload_bytes"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"), bare("WARC-Refers-To").alias("refers_to_record"), number.alias("chunk_no"),
        (field("WARC-Segment-Number").isNull() | field("WARC-Segment-Total-Length").isNotNull()).alias("last"),
        F.when(first, F.expr(f"substring(block, instr(block, '{END_OF_RECORD}') + 4)")).otherwise(F.col("block")).alias("chunk"), digest("X-Digest-So-Far").alias("digest_so_far"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an archive. Digest and length of a response are of the payload read, and must be those it was written with; a revisit has its header's."""
    chunks = read_chunks(spark, path)
    alone = (F.col("chunk_no") == 1) & F.col("last")
    revisit = F.col("record_type") == "revisit"
    read = F.when(revisit, F.col("payload_digest")).otherwise(_sha(F.col("chunk")))
    checked = F.when(read == F.col("payload_digest"), read).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("record_id"))))
    whole = chunks.filter(alone).select(
        "record_id", "page_id", "url", "record_type", F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("chunk").cast("long")).alias("payload_bytes"),
        checked.alias("payload_digest"), "refers_to",
    )
    parts = chunks.filter(~alone).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return whole.unionByName(parts.select(*_CHUNKS_ARROW.names).mapInArrow(_joined, RECORDS))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of sorted chunks, streamed: only a digest and the first chunk's fields are kept of a record."""
    head, digest, n, at = None, None, 0, 0
    for batch in batches:
        out = []
        chunks = batch.column("chunk")
        for row, chunk in zip(batch.drop_columns(["chunk"]).to_pylist(), chunks, strict=True):
            if head is None:
                head, digest, n, at = row, hashlib.sha256(), 0, 0
            view = chunk.as_buffer()
            digest.update(view)
            n, at = n + view.size, at + 1
            so_far = digest.hexdigest()
            if row["record_id"] != head["record_id"] or row["chunk_no"] != at or so_far != row["digest_so_far"]:
                raise ValueError(f"record {head['record_id']}: chunk {at} is missing or damaged")
            if row["last"]:
                if so_far != row["payload_digest"] or n != row["payload_bytes"]:
                    raise ValueError(f"record {head['record_id']}: the payload is damaged")
                out.append({**{c: head[c] for c in ("record_id", "page_id", "url", "record_type", "refers_to")}, "payload_bytes": n, "payload_digest": so_far})
                head = None
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RECORDS_ARROW)
    if head is not None:
        raise ValueError(f"record {head['record_id']}: the last chunk is missing")


def scratch_archive(spark: SparkSession) -> str:
    """A new folder for an archive in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/folioflow-warc-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path
