"""WARC archives: writer and boundary-chain reader.

Writing
    One record a row through Spark's text sink: header lines, an empty line,
    the payload, and the record end ``CR LF CR LF`` as the sink's separator,
    compressed as one gzip stream a file, with at most ``records`` records
    a file.  Records with equal payloads of at least ``least`` bytes are
    stored once: the one with the largest id is the response, the others are
    revisit records without a block that name it and carry the payload's
    digest and length.

Reading
    The files are scanned once in pieces that end at each occurrence of the
    version line, wherever it occurs, also inside a payload.  A piece is a
    candidate record: its task adds up the offsets in the file's stream and
    emits (offset, successor), the successor being computed from the header
    and Content-Length.  Pointer jumping over these offsets, from offset 0 of
    every file, keeps the candidates that the chain of records reaches: after
    round k all records within 2^k of the file's start are marked, so the
    rounds grow with the logarithm of the records in a file.  Candidates that
    the chain never meets are payload bytes, and are joined back to the record
    that holds them.  A stream that breaks off in mid-record, or a chain that
    leaves the file's candidates, ends there: what cannot be reached is not a
    record.

    A gzip stream is not split, so offsets are those of the whole file; the
    reader raises an error if Spark splits a file (plain files).

Edge cases: null payload is empty; null target is left out of the header;
control characters and white space in a target are percent-encoded; a null
id writes no id header and reads back as null; repeated rows are written
and read as many times as they occur (those with the largest id of their
payload are all responses); an empty table writes no record and reads as an
empty table.  Only the id, target and payload columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layover.llm.common import prepare, staged

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
BROADCAST_ROWS = 200_000  # rows of a 3-column table that may be broadcast


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a staged table of a checked size, else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _record_id(key) -> F.Column:
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", target: str = "url", payload: str = "html",
                   date: str = "2026-01-01T00:00:00Z", least: int = 1000, records: int = 4096) -> str:
    """Write one record per row below ``path`` (a folder Spark can write)."""
    prepare(pages.sparkSession)
    p = pages.select(F.col(key).cast("long").alias("id"), F.col(target).alias("target"),
                     F.coalesce(F.col(payload), F.lit("")).alias("body"))
    p = p.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body"))
    # one row for each payload that occurs with several ids: its largest id
    same = (p.where(F.col("bytes") >= least).groupBy("digest")
            .agg(F.max("id").alias("first"), F.min("id").alias("other"), F.count(F.lit(1)).alias("k"))
            .where("k > 1").select(F.col("digest").alias("d"), "first"))
    same = _small(staged(same, "same"))
    p = p.join(same, (p["digest"] == same["d"]) & (F.col("bytes") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    safe = F.col("target")
    for c, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        safe = F.replace(safe, F.lit(c), F.lit(code))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    none = F.lit("")
    head = F.concat(
        F.lit(VERSION), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe), none), F.coalesce(line("X-Row-ID", F.col("id").cast("string")), none),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", _record_id(F.col("first"))),
            line("X-Refers-To-Row", F.col("first").cast("string")),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit("\r\n"))
    out = p.select(F.concat(head, F.when(revisit, none).otherwise(F.col("body"))).alias("value"))
    (out.write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records).text(path))
    return path


_FIELD = re.compile(r"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$", re.M)


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, v in _FIELD.findall(head.decode("utf-8", "replace").replace("\r\n", "\n"))}


def _pieces(batches, full: bool):
    """Rows (file, block, piece) of a file in order -> candidates.  The
    running offset belongs to the file that the task is reading."""
    file, at = None, 0
    for b in batches:
        rows = []
        for f, block, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if block:
                raise ValueError(f"{f} was split; write archives as gzip streams")
            if f != file:  # what stands before the first version line
                file, at, start = f, len(piece), None
                if full and piece:
                    rows.append((f, -1, None, piece))
                elif piece:
                    rows.append((f, -1, -1, None))
                continue
            start, at = at, at + len(VERSION) + len(piece)
            head, gap, _ = piece.partition(END.encode())
            length = _fields(head).get("content-length", "") if gap else ""
            after = start + len(VERSION) + len(head) + 2 * len(END) + int(length) if length.isdecimal() and len(length) < 19 else None
            rows.append((f, start, after, piece) if full else (f, start, after, at))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary() if full else pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         ["file", "at", "after", "piece" if full else "until"])


def _scan(spark: SparkSession, path: str, full: bool) -> DataFrame:
    t = spark.read.option("lineSep", VERSION).text(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.col("value").cast("binary").alias("piece"))
    return t.mapInArrow(lambda bs: _pieces(bs, full),
                        "file string, at long, after long, " + ("piece binary" if full else "until long"))


def reachable(candidates: DataFrame) -> DataFrame:
    """Pointer jumping: ``candidates(file, at, after)`` -> the (file, at) that
    the chain from offset 0 of each file reaches.

    ``ptr`` of a candidate is the candidate 2^k records on (null beyond the
    end of the chain); a round marks the targets of marked candidates and
    doubles every pointer."""
    here = candidates.select("file", "at")
    t = candidates.select("file", "at", F.col("after").alias("ptr"), (F.col("at") == 0).alias("on"))
    ends = here.withColumnRenamed("at", "ptr").withColumn("there", F.lit(True))
    t = staged(t.join(ends, ["file", "ptr"], "left")
               .select("file", "at", F.when(F.col("there"), F.col("ptr")).alias("ptr"), "on"), "chain")
    while not t.where("ptr is not null").isEmpty():
        hit = t.where("on and ptr is not null").select("file", F.col("ptr").alias("at"), F.lit(True).alias("hit")).distinct()
        next_ = t.select("file", F.col("at").alias("ptr"), F.col("ptr").alias("ptr2"))
        t = staged(t.join(next_, ["file", "ptr"], "left").join(hit, ["file", "at"], "left")
                   .select("file", "at", F.col("ptr2").alias("ptr"), (F.col("on") | F.col("hit").isNotNull()).alias("on")), "chain")
    return t.where("on").select("file", "at")


def _records(batches):
    """(file, at, piece) of whole records -> parsed records; a record whose
    stream ends before its length does is dropped as cut off."""
    for b in batches:
        rows = []
        for f, at, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            head, _, rest = piece.partition(END.encode())
            h = _fields(head)
            n = int(h["content-length"])
            if len(rest) < n:
                continue
            number = lambda k: int(h[k]) if re.fullmatch(r"-?\d+", h.get(k, "")) else None  # noqa: B023, E731
            rows.append((f, at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), number("x-row-id"),
                         number("x-refers-to-row"), h.get("warc-refers-to"),
                         h.get("warc-payload-digest", "").removeprefix("sha1:") or None, rest[:n]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
        s, n = pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (s, n, s, s, s, n, n, s, s, pa.binary()), strict=True)], _NAMES)


_NAMES = ["file", "at", "type", "record_id", "target", "row_id", "refers_to_row", "refers_to", "digest", "payload"]
_KIND = ("file string, at long, type string, record_id string, target string, row_id long, refers_to_row long, "
         "refers_to string, digest string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: file, at (offset), type,
    record_id, target, row_id, refers_to_row, refers_to, digest (as written)
    and payload (the block's bytes)."""
    prepare(spark)
    c = staged(_scan(spark, path, full=False), "candidates")
    c = c.where("at >= 0")
    on = reachable(c)
    # A usual piece is a whole record by itself.  Others: pieces the chain
    # does not meet (they belong to the record before them), the records
    # that hold such pieces, and records whose block breaks off.
    c = c.join(on.withColumn("on", F.lit(True)), ["file", "at"], "left")
    odd = c.where("on is null or after is null or after <> until").select("file", "at", "on")
    odd = staged(odd, "odd")
    raw = _scan(spark, path, full=True).where("at >= 0")
    marked = raw.join(_small(odd).withColumnsRenamed({"file": "f", "at": "a"}).withColumn("odd", F.lit(True)),
                      (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")), "left")
    whole = marked.where("odd is null").select("file", "at", "piece").mapInArrow(_records, _KIND)
    if odd.isEmpty():
        return whole
    return whole.unionByName(_joined(marked.where("odd").select("file", "at", "on", "piece")))


def _joined(odd: DataFrame) -> DataFrame:
    """Records put together from their pieces.  A piece belongs to the last
    reached record at or before it; the pieces of a record follow each
    other, so all of them are among the odd ones."""
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = odd.select("file", "at", "on").withColumn("rec", F.max(F.when(F.col("on"), F.col("at"))).over(w))
    x = odd.join(heads.select("file", "at", "rec"), ["file", "at"]).where("rec is not null")
    x = x.groupBy("file", "rec").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    # the version line that ended a piece is part of the payload
    joined = F.unhex(F.array_join(F.transform("p", lambda s: F.hex(s["piece"])), VERSION.encode().hex().upper()))
    return x.select("file", F.col("rec").alias("at"), joined.alias("piece")).mapInArrow(_records, _KIND)


def with_full_payload(records: DataFrame) -> DataFrame:
    """Digest and length of the payload of every record.  Responses are
    measured from their block; revisits take both from the response of the
    same digest (one row a digest; a revisit without one keeps its written
    digest and a null length)."""
    m = records.select("file", "at", "type", "record_id", "row_id", "refers_to_row", "refers_to",
                       F.col("digest").alias("written"), F.sha1("payload").alias("own"),
                       F.octet_length("payload").cast("long").alias("own_bytes"))
    m = staged(m, "measured")
    stored = m.where("type = 'response'").groupBy("record_id", F.col("own").alias("d")).agg(F.first("own_bytes").alias("b"))
    stored = stored.withColumnRenamed("record_id", "rid")
    visits = m.where("type = 'revisit'").join(
        stored, (F.col("refers_to") == F.col("rid")) & (F.col("written") == F.col("d")), "left")
    cols = ["row_id", "type", "refers_to_row"]
    return (m.where("type is null or type <> 'revisit'").select(*cols, F.col("own").alias("payload_digest"), F.col("own_bytes").alias("payload_bytes"))
            .unionByName(visits.select(*cols, F.coalesce("d", "written").alias("payload_digest"), F.col("b").alias("payload_bytes"))))
