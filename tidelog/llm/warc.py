"""WARC archives: writing captures, reading records back, and joining them into transactions.

A capture is a response (or a revisit of an equal payload), the request that led to it and a metadata record. The
latter two name the first in WARC-Concurrent-To; assembly follows such identifiers in either direction, over any number
of records in between, and gives one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.shingles import lean
from tidelog.session import Scratch
from tidelog.sources.ranges import listed, opened

#: Payloads of fewer bytes are stored again each time.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
#: Records in an archive file at most; a file is read as a stream by one task, whatever its size.
PER_FILE = 60_000
#: Payload bytes in a batch that the reader hands on.
BATCH = 4 << 20
_CRLF = "\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def _field(name: str, value: Column, clean: bool = False) -> Column:
    """A header line; none for a null value. Line ends in values become spaces, unless the value is known to be clean."""
    value = value.cast("string")
    value = value if clean else F.when(value.rlike("[\r\n]"), F.regexp_replace(value, "[\r\n]+", " ")).otherwise(value)
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def _record(kind: str | Column, block: Column, size: Column, content_type: str, *fields: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    last = F.lit(f"WARC-Date: {DATE}{_CRLF}Content-Type: {content_type}{_CRLF}Content-Length: ")
    return F.concat(F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind, F.lit(_CRLF), *fields, last, size.cast("string"), F.lit(_CRLF * 2), block)


def captures_of(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, and original: null for a response, else the page revisited.

    Digests of at least `least` bytes that occur more than once are counted without their payloads, and written; the
    join with them reads two tables as they are, so that Spark can split a payload that very many pages share.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.where(F.octet_length("payload") >= least)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    shared = scratch.save(shared, "shared")
    again = F.col("first").isNotNull() & ~F.equal_null("page_id", "first")
    return rows.join(shared, "digest", "left").withColumn("original", F.when(again, F.col("first"))).drop("first")


def write_archives(captures: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Writes three records per row of captures_of as gzip-compressed WARC files.

    Identifiers follow from the row and from its place in the reading, so that rows that repeat are captures of their
    own. All three records of a capture come from one task, whose files Spark's text writer publishes whole by its
    commit protocol: a lost executor leaves no half archive, and no identifier without its partners.
    """
    base = captures.withColumn("__place", F.monotonically_increasing_id())
    base = base.withColumn("__id", _uuid(F.lit("capture"), F.col("page_id"), F.col("digest"), F.col("url"), F.col("__place")))
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace(F.col("url"), "[\r\n ]+", "%20"), F.lit("/")), F.lit(" HTTP/1.1" + _CRLF * 2))
    size = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), size.cast("string"), F.lit(_CRLF * 2))
    known = F.concat(_field("page-id", F.col("page_id"), True), _field("refers-to-page", F.col("original"), True))
    part = lambda name: F.concat(F.regexp_replace("__id", ">$", ""), F.lit(f"-{name}>"))
    base = base.select(
        "payload", "digest", "original", F.col("__id").alias("id"), part("request").alias("request_id"), part("metadata").alias("metadata_id"),
        _field("WARC-Target-URI", F.col("url")).alias("target"), asked.alias("asked"), http.alias("http"), known.alias("known"),
    )
    revisit = F.col("original").isNotNull()
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), F.concat("http", F.when(revisit, "").otherwise(F.col("payload"))), F.octet_length("http") + F.when(revisit, 0).otherwise(F.octet_length("payload")), "application/http; msgtype=response",
        _field("WARC-Record-ID", F.col("id"), True), F.col("target"), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"), True),
        F.when(revisit, f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}").otherwise(""), _field("WARC-Refers-To-Target-URI", F.concat(F.lit("page:"), F.col("original").cast("string")), True),
    )
    side = lambda kind, block, type_: _record(kind, F.col(block), F.octet_length(block), type_, _field("WARC-Record-ID", F.col(f"{kind}_id"), True), F.col("target"), _field("WARC-Concurrent-To", F.col("id"), True))
    three = base.select(side("request", "asked", "application/http; msgtype=request").alias("a"), main.alias("b"), side("metadata", "known", "application/warc-fields").alias("c"))
    lines = three.select(F.explode(F.array("a", "b", "c")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", _CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


class Framed:
    """Reads exactly so many bytes, or up to a mark, from a file; keeps no more than what is asked for and a chunk."""

    def __init__(self, source: BinaryIO):
        self.rest, self.chunks, self.at = b"", self._opened(source), 0

    @staticmethod
    def _opened(source: BinaryIO) -> Iterator[bytes]:
        """Chunks of the file, unpacked if it is a row of gzip members."""
        step = 1 << 18
        data = source.read(step)
        if data[:2] != b"\x1f\x8b":
            while data:
                yield data
                data = source.read(step)
            return
        member = zlib.decompressobj(31)
        while data:
            yield member.decompress(data)
            data = member.unused_data if member.eof else b""
            if member.eof:
                member = zlib.decompressobj(31)
                fresh = True
            else:
                fresh = False
            data = data or source.read(step)
        if not fresh:
            raise ValueError("a gzip member is cut short")

    def _more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.rest += chunk
                return True
        return False

    def take(self, n: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                raise ValueError("a record is cut short")
            parts.append(chunk)
            have += len(chunk)
        whole = b"".join(parts)
        self.rest, self.at = whole[n:], self.at + n
        return whole[:n]

    def upto(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """What stands before the mark, which is passed too; None at the end of the file."""
        while (k := self.rest.find(mark)) < 0:
            if len(self.rest) > most or not self._more():
                if self.rest.strip():
                    raise ValueError("a record header has no end")
                return None
        return self.take(k + len(mark))[:k]


RECORD = "file string, position long, type string, record_id string, concurrent_to array<string>, target_uri string, fields map<string,string>, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"


def parsed(file: BinaryIO, keep: bool) -> Iterator[tuple]:
    """A record's values after `file`. Header names are lower-cased; one that repeats keeps its last value, besides
    WARC-Concurrent-To, of which all count. A payload is what follows the HTTP head; warc-fields blocks join fields."""
    source = Framed(file)
    while True:
        while source.rest[:2] == b"\r\n" or (not source.rest and source._more()):
            if source.rest[:2] == b"\r\n":
                source.take(2)
        at = source.at
        head = source.upto(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k]
        fields = dict(pairs)
        block = source.take(int(fields["content-length"]))
        http, body = fields.get("content-type", "").startswith("application/http"), block
        if http:
            top, _, body = block.partition(b"\r\n\r\n")
            fields |= {f"http-{k.strip().lower()}": v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:]) if k}
        elif fields.get("content-type") == "application/warc-fields":
            fields |= {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k}
        kind = fields.get("warc-type", "")
        said = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if kind == "revisit":
            size, digest, ok = int(fields.get("http-content-length", 0)), said, True
        else:
            size, digest = len(body), hashlib.sha256(body).hexdigest()
            ok = said in (None, digest)
        yield at, kind, fields.get("warc-record-id"), [v for k, v in pairs if k == "warc-concurrent-to"], fields.get("warc-target-uri"), list(fields.items()), size, digest, ok, body if keep else None


def record_batches(keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (path) to RECORD."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with opened(path) as file:
                    for record in parsed(file, keep):
                        rows.append((path, *record))
                        held += len(record[-1] or b"") + 500
                        if held > BATCH:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return work


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The RECORD rows of all archives under a path or pattern; without payloads if only their sizes and digests are
    wanted. A task reads whole files, each as a stream, so that an archive may be of any size."""
    files = listed(spark, path)
    paths = spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(max(1, min(len(files), 10_000)), "path")
    return paths.mapInArrow(lean(record_batches(payloads)), RECORD)


MAIN = ("response", "revisit")


def transactions(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per capture: capture_id, capture, request, metadata (structs of a record), n_requests, n_metadata.

    A capture is a response or revisit record. Another record belongs to it if either names the other as concurrent,
    or if a third that belongs to it is named by or names that record, over any number of records in between; of
    several captures to one with the fewest in between, the first by identifier. Of several requests, or metadata records, the first by identifier is nested and all are counted.
    Records that repeat an identifier count once. A record that no capture is found for is a row of its own, with a
    null capture. records are read several times: hand over a written table.
    """
    whole = F.struct("type", "record_id", "target_uri", "fields", "payload_bytes", "payload_digest", "digest_ok", "payload")
    ids = records.where("record_id is not null").select("record_id", F.col("type").isin(*MAIN).alias("main"), "concurrent_to")
    named = ids.select(F.col("record_id").alias("a"), F.col("main").alias("a_main"), F.explode("concurrent_to").alias("b"))
    mains = ids.where("main").select(F.col("record_id").alias("b"), F.lit(True).alias("b_main")).distinct()
    links = scratch.save(named.join(mains, "b", "left").select("a", "b", "a_main", F.coalesce("b_main", F.lit(False)).alias("b_main")), "links")
    turned = lambda df: df.select(F.col("a").alias("b"), F.col("b").alias("a"))
    direct = links.where("b_main and not a_main").select("a", F.col("b").alias("c")).union(links.where("a_main and not b_main").select(F.col("b").alias("a"), F.col("a").alias("c")))
    reached = scratch.save(direct.groupBy("a").agg(F.min("c").alias("capture_id")), "over-0")
    rest = links.where("not a_main and not b_main").select("a", "b")
    last, k = reached, 0
    if rest.limit(1).count():
        pairs = scratch.save(rest.union(turned(rest).select("a", "b")).distinct(), "pairs")
        while True:  # once for each record in between
            k += 1
            near = pairs.join(last.withColumnRenamed("a", "b"), "b").select("a", "capture_id").join(reached.select("a"), "a", "left_anti")
            last = scratch.save(near.groupBy("a").agg(F.min("capture_id").alias("capture_id")), f"over-{k}")
            if last.limit(1).count() == 0:
                break
            reached = reached.union(last)
    others = records.where(~F.col("type").isin(*MAIN) | F.col("record_id").isNull()).select("record_id", "type", whole.alias("record"))
    owned = others.join(reached, others["record_id"] == reached["a"], "left").drop("a")
    owned = owned.select("type", "record_id", "record", F.coalesce("capture_id", "record_id").alias("capture_id"))
    pick = lambda kind: F.min_by("record", F.when(F.col("type") == kind, F.col("record_id"))).alias(kind)
    count = lambda kind: F.count_distinct(F.when(F.col("type") == kind, F.col("record_id")))
    sides = owned.groupBy("capture_id").agg(F.min_by("record", F.when(F.col("type") == "request", F.col("record_id"))).alias("request"), pick("metadata"), count("request").alias("n_requests"), count("metadata").alias("n_metadata"))
    sides = scratch.save(sides, "sides")
    main = records.where(F.col("type").isin(*MAIN) & F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("capture_id")).agg(F.first(whole).alias("capture"))
    return main.join(sides, "capture_id", "full")


def query(pages: DataFrame) -> DataFrame:
    """A capture per row, rows that repeat one another too. A null page_id is never the one that others revisit; of
    equal payloads, all rows of the smallest page_id are responses. Clashing and further columns are ignored."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(captures_of(pages, scratch), scratch.at("archives"))
    records = scratch.save(read_archives(spark, scratch.at("archives"), payloads=False), "records")
    found = transactions(records, scratch)
    said = lambda k: F.element_at("metadata.fields", k).cast("long")
    return found.select(
        said("page-id").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        said("refers-to-page").alias("refers_to"),
        F.col("request.target_uri").alias("url"),
        F.col("capture.digest_ok").alias("digest_ok"),
    )


def sql() -> str:
    return f"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select *, strlen(html) as n, sha256(html) as h from p),
m as (select *, min(page_id) over (partition by h) as first from d)
select page_id, n::bigint as payload_bytes, h as payload_digest,
       case when n >= {LEAST} and first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when n >= {LEAST} and page_id is distinct from first then first end as refers_to,
       url, true as digest_ok
from m"""
