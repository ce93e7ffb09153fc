"""Token counts by a separator scan over flat token files.

A flat file holds token ids of fixed width, one document after another, each closed by an end-of-document id, and no
index. Blocks of a file are searched for that id at once with numpy; a document that runs over block edges is stitched
by a prefix scan over the blocks' last separators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.shingles import in_pieces, lean
from tidelog.llm.tokens import VOCABULARY, encoder, forget
from tidelog.session import Scratch

#: Id that ends a document: the vocabulary's <|endoftext|>, which no text encodes to.
END = 49407
#: Bytes of an id; unsigned, little-endian.
WIDTH = 2
BLOCK = 8 << 20


MANIFEST = "doc_id long, file string, ordinal long"


def created(path: str) -> BinaryIO:
    """A new file in any store that this process can open."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "wb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name)


def file_batches(path: str, vocabulary: str, end: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (doc_id, text) to MANIFEST; each task writes its texts' ids to a file of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, specials=False).encode
        close = end.to_bytes(width, "little")
        name, ordinal, f = f"{path}/{uuid.uuid4().hex}.bin", 0, None
        try:
            for batch in batches:
                for piece in in_pieces(batch, 1):
                    f = f or created(name)
                    for text in piece.column(1).to_pylist():
                        f.write(np.frombuffer(encode(text or ""), "<u4").astype(f"<u{width}").tobytes() + close)
                    n = piece.num_rows
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n))], names=["doc_id", "file", "ordinal"])
                    ordinal += n
        finally:
            if f:
                f.close()

    return work


def write_tokens(documents: DataFrame, scratch: Scratch, name: str, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH) -> DataFrame:
    """Writes texts (doc_id, text) as flat token files under a name of the scratch folder; MANIFEST, as a written table.

    A task writes a file of a new name and hands on which document stands where in it. Only the rows of tasks that
    count reach the table, so it names exactly the files that count: what a lost executor or a second attempt left
    behind is in no row. Nothing is read twice, so no document can get another's place. A null text has no ids; an
    empty task writes no file; rows that repeat are documents each; other columns are ignored.
    """
    scratch.folder(name)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.save(rows.mapInArrow(lean(file_batches(scratch.at(name), vocabulary, end, width), forget), MANIFEST), f"{name}-manifest")


def read_range(path: str, start: int, length: int) -> bytes:
    """Bytes of a file in any store that this process can open."""
    if path.startswith("file:"):
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
            f.seek(start)
            return f.read(length)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(length, start)


def scanned_batches(end: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (path, block, start, length) to the same with ends: places, in ids from the file's start, of the end id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, _, start, length = (batch.column(c)[k].as_py() for c in range(4))
                data = read_range(path, start, length)
                if len(data) != length or length % width:
                    raise ValueError(f"{path}: {len(data)} bytes at {start}, not {length} of width {width}")
                ends = np.flatnonzero(np.frombuffer(data, f"<u{width}") == end) + start // width
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([ends], pa.list_(pa.int64()))], names=[*batch.schema.names, "ends"])

    return work


def counted(spark: SparkSession, files: list[tuple[str, int]], scratch: Scratch, end: int = END, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document of the files (path, bytes): file, ordinal (from 0 in its file), start, n_tokens, closed.

    start and n_tokens count ids without the end id. Ids after the last end id of a file are a document that is not
    closed; a file without any id has no document. The list of files is as long as the writer had tasks.
    """
    block -= block % width
    listed = spark.createDataFrame([(p, n) for p, n in files if n], "path string, bytes long")
    blocks = listed.select("path", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block})")).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * block).alias("start"), F.least(F.lit(block), F.col("bytes") - F.col("block") * block).alias("length"))
    total = sum(-(-n // block) for _, n in files)
    seen = blocks.repartition(max(1, min(total, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(lean(scanned_batches(end, width)), "path string, block long, start long, length long, ends array<long>")
    seen = scratch.save(seen, "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.expr("try_element_at(ends, -1)"))
    stitched = seen.select("path", "ends", F.coalesce(last.over(before), F.lit(-1)).alias("last"), F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"))
    each = stitched.select("path", "ends", "last", "earlier", F.posexplode("ends").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("last")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    closed = each.select("path", (F.col("earlier") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = seen.groupBy("path").agg(F.sum("length").alias("bytes"), F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.expr("try_element_at(ends, -1)")), F.lit(-1)).alias("last"))
    open_ = tails.where(F.expr(f"bytes div {width} > last + 1")).select("path", "ordinal", (F.col("last") + 1).alias("start"), (F.expr(f"bytes div {width}") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(open_).withColumnRenamed("path", "file")


def query(documents: DataFrame) -> DataFrame:
    """Each document's count, scanned from the flat files that its text was written to.

    The files hold no document ids and no index; the manifest that was written with them says which document stands
    where. A document without a count, or a count without a document, is an error.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "tokens")
    order = write_tokens(documents, scratch, "flat")
    # a row per task that wrote
    names = {r["file"] for r in order.select("file").distinct().collect()}
    files = [(p, n) for p, n in scratch.files("flat") if p.rsplit("/", 1)[-1] in {x.rsplit("/", 1)[-1] for x in names}]
    counts = counted(spark, files, scratch)
    base = lambda c: F.substring_index(c, "/", -1)
    counts = counts.select(base("file").alias("file"), "ordinal", "start", "n_tokens", "closed")
    both = order.select("doc_id", base("file").alias("file"), "ordinal", F.lit(True).alias("known")).join(counts, ["file", "ordinal"], "full")
    sure = F.when(F.col("known") & F.col("closed"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("token files and documents do not match")).cast("long"))
    return both.select("doc_id", sure.alias("n_tokens"), "file", "ordinal", F.col("start").alias("first_token"))
