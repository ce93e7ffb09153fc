"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

Plan, in tables that are written once each:

1. Sketch: every text's shingle set gives its size, a 128-bit fingerprint of the whole set and a signature. Equal sets
   form a class; its smallest document stands for it from here on, so copies cost nothing further.
2. Candidates: representatives that agree on a band share a bucket. Each is paired with the bucket's smallest member
   only, so a bucket of thousands makes thousands of pairs, not millions. Pairs are verified on their full sets.
3. Members of one bucket that are in different components still are compared in full: those outside its largest
   component with all of other components. Small buckets are joined with themselves, large ones compared in blocks.
4. Components of all verified pairs.

Every pair that shares a bucket is thus verified or already connected: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.shingles import bytes_of, in_pieces, lean, mixed, shingle_sets, word_hashes
from tidelog.session import Scratch

#: 25 bands of 5: a pair at similarity 0.85 shares none with a chance of 4e-7, one at 0.8 with 5e-5.
BANDS, ROWS = 25, 5
#: A bucket of more members that are still apart is compared in blocks, of this many members and as many that ask.
SMALL, BLOCK = 16, 512
#: A pair's percentage of equal signature places may fall short of the similarity asked for by this: 6 deviations.
SLACK = 20
#: Bits of a Bloom filter at most: 16 MB.
BLOOM = 1 << 27


def super_min_hash(elements: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m, uint64) of sets given as one array of elements with their rows' numbers.

    In step j an element sends j + u to place pi(j) of its own random permutation pi; a place keeps the least value.
    Values of step j lie above all of the steps before, so a row stops as soon as every place of it is taken; a set
    of thousands stops after one or two steps, and only the elements of rows that go on carry a permutation.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * m, none, np.uint64)
    perm = None
    for j in range(m):
        if not len(elements):
            break
        step = np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1)
        drawn = mixed(elements + step)
        pick = (j + ((drawn & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24))).astype(np.int64)
        each = np.arange(len(elements))
        if j == 0:
            place = pick
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
                perm[each, 0], perm[each, first] = perm[each, first], perm[each, 0]
            place = perm[each, pick].astype(np.int64)
            perm[each, pick] = perm[:, j]
        value = (np.uint64(j) << np.uint64(40)) | (drawn >> np.uint64(24))
        np.minimum.at(out, row * m + place, value)
        going = (out.reshape(rows, m) == none).any(axis=1)[row]
        if j == 0:
            first = pick[going]
        elif perm is not None:
            perm = perm[going]
        elements, row = elements[going], row[going]
    return out.reshape(rows, m)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each row and band; keys of different bands differ."""
    parts = signatures.reshape(len(signatures), bands, rows)
    factor = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    total = (mixed(parts) * factor).sum(axis=2, dtype=np.uint64)
    return mixed(total + mixed(np.arange(bands, dtype=np.uint64) + np.uint64(77)))


SKETCH = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>, signature array<short>"


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sketch_batches(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (doc_id, text) to SKETCH; a signature keeps 16 bits of each place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1):
                sets = list(shingle_sets(*word_hashes(*bytes_of(piece.column(1)))))
                size = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                row = np.repeat(np.arange(len(sets)), size)
                marks = [np.zeros(len(sets), np.uint64) for _ in range(2)]
                has = np.flatnonzero(size)
                starts = np.concatenate(([0], np.cumsum(size)))[has]
                for k, mark in enumerate(marks):
                    if len(has):
                        mark[has] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1)), starts)
                signatures = super_min_hash(flat, row, len(sets), bands * rows)
                keys = band_keys(signatures, bands, rows)
                offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
                short = (mixed(signatures[has]) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
                places = pa.array(offsets * np.int32(rows))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), pa.array(size), _longs(marks[0]), _longs(marks[1]), pa.ListArray.from_arrays(pa.array(offsets), _longs(keys[has].ravel())), pa.ListArray.from_arrays(places, pa.array(short.ravel()))],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "bands", "signature"],
                )

    return work


def bloom(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n ids (one column of longs) as 64-bit words: 16 bits for each id, BLOOM bits at most.

    Words are combined by Spark; only the filter, whose size has that bound, reaches the driver. One that is too full
    lets every id pass, which costs time and nothing else.
    """
    bits = min(BLOOM, max(1 << 10, 1 << (16 * n - 1).bit_length()))
    hashed = ids.select(F.explode(F.array(*[F.xxhash64(ids.columns[0], F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in (1, 2)])).alias("bit"))
    words = hashed.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def set_batches(words: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (doc_id, text, bit, bit) to (doc_id, shingles) for those whose bits are both in the filter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.ones(batch.num_rows, bool)
            for c in (2, 3):
                bit = batch.column(c).to_numpy()
                held &= (words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for piece in in_pieces(batch.select([0, 1]).filter(pa.array(held)), 1):
                sets = list(shingle_sets(*word_hashes(*bytes_of(piece.column(1)))))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), _longs(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))], names=["doc_id", "shingles"])

    return work


def sets_of(ids: DataFrame, documents: DataFrame, scratch: Scratch, name: str, parts: int | None = None) -> DataFrame:
    """(doc_id, shingles) for ids (one column), and for some documents more.

    The sets are made from the texts anew, where these are read: a Bloom filter picks the texts, so none is shuffled.
    The ids are written in `parts` if given.
    """
    need = scratch.save(ids.toDF("doc_id").distinct(), f"{name}-need", parts)
    words = bloom(need, need.count())
    bit = [F.xxhash64("doc_id", F.lit(k)).bitwiseAND(F.lit(64 * len(words) - 1)) for k in (1, 2)]
    made = documents.where("doc_id is not null").select("doc_id", "text", *[b.alias(f"bit_{k}") for k, b in enumerate(bit)]).mapInArrow(lean(set_batches(words)), "doc_id long, shingles array<long>")
    out = scratch.save(made, name)
    scratch.drop(f"{name}-need")
    return out


def alike(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose signatures (doc_id, signature) agree in enough places to be verified."""
    signed = lambda end: signatures.select(F.col("doc_id").alias(end), F.col("signature").alias(f"signature_{end}"))
    same = F.size(F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda x: x))
    return pairs.join(signed("a"), "a").join(signed("b"), "b").where(100 * same >= (percent - SLACK) * F.size("signature_a")).select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose full shingle sets have 100 * intersection >= percent * union."""
    of = lambda end: sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"set_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b").distinct()


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and its rows' offsets in them."""
    lists = column.combine_chunks()
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0] : at[-1]], at - at[0]


def block_links(percent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Compares a block of a bucket's minor members (asks) with a block of all its members, on their full sets.

    A pair of different components is compared in the bucket of the first band that both share, if their signatures
    are near enough. Links that join what others here have joined already are not handed on, so that the links of a
    block are fewer than its members.
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        ids, label, asks = table["rep"].to_numpy(), table["label"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        signatures = _rows(table["signature"])[0].reshape(len(ids), -1)
        bands = _rows(table["bands"])[0].reshape(len(ids), -1)
        values, at = _rows(table["shingles"])
        size = np.diff(at)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        links = []
        block = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks).tolist():
            others = block[label[block] != label[x]]
            shared = bands[others] == bands[x]
            others = others[bands[x][np.argmax(shared, axis=1)] == bucket] if len(others) else others
            others = others[100 * (signatures[others] == signatures[x]).mean(axis=1) >= percent - SLACK] if len(others) else others
            if not len(others):
                continue
            flat = np.concatenate([values[at[y] : at[y + 1]] for y in others.tolist()])
            own = np.sort(values[at[x] : at[x + 1]])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(size[others])[:-1])))
            for y in others[100 * common >= percent * (size[x] + size[others] - common)].tolist():
                a, b = top(int(label[x])), top(int(label[y]))
                if a != b:
                    root[a] = b
                    links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return work


def grouped(documents: DataFrame, scratch: Scratch, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are null-safe; a text without words has an empty set and links with nothing. Rows of one doc_id count as
    one document. Rows without a doc_id are kept and have no component. Columns besides doc_id and text are ignored.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.save(narrow.mapInArrow(lean(sketch_batches(bands, rows)), SKETCH), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    prints = ["print_a", "print_b", "n_shingles"]
    copies = full.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    few = scratch.parts("sketches")
    copies = scratch.save(copies, "copies", few)
    members = scratch.save(sketches.join(copies, prints, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), F.when(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id")), F.col("bands")).alias("bands")), "members", few)
    scratch.drop("copies")

    entries = members.where("n_shingles > 0 and rep is not null").select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size")).where("center < last").drop("last")
    shared = scratch.save(shared, "shared", few)
    buckets = scratch.save(entries.join(shared, "bucket").select("bucket", "rep", "center", "size"), "buckets", few)
    scratch.drop("shared")
    starred = scratch.save(buckets.where("center < rep").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "starred", few)
    signatures = sketches.where("n_shingles > 0 and doc_id is not null").select("doc_id", "signature")
    near = scratch.save(alike(starred, signatures, percent), "near", few)
    sets = sets_of(near.select("a").union(near.select("b")), narrow, scratch, "star-sets", few)
    links = scratch.save(verified(near, sets, percent), "star-links", max(few, scratch.parts("star-sets")))
    scratch.drop("star-sets", "near")
    labels = components(links, scratch, "stars", few)

    # What stars left apart within a bucket: members outside its largest component are compared with all of others.
    placed = scratch.save(buckets.join(labels, buckets["rep"] == labels["node"], "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label")), "placed", few)
    scratch.drop("buckets")
    parts = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    apart = parts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("minors")).where("labels > 1")
    apart = scratch.save(apart.select("bucket", "main", "size", "minors"), "apart", few)
    left = scratch.save(placed.join(apart, "bucket").select("bucket", "rep", "label", "size", "minors", (F.col("label") != F.col("main")).alias("minor")), "left", few)
    scratch.drop("apart", "placed")
    small = left.where(f"size <= {SMALL}")
    x = small.where("minor").select("bucket", F.col("rep").alias("x"), F.col("label").alias("lx"))
    y = small.select("bucket", F.col("rep").alias("y"), F.col("label").alias("ly"))
    pairs = x.join(y, "bucket").where("lx <> ly").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = scratch.save(alike(pairs.join(starred, ["a", "b"], "left_anti"), signatures, percent), "near", few)
    large = left.where(f"size > {SMALL}")
    sets = sets_of(near.select("a").union(near.select("b")).union(large.select("rep")), narrow, scratch, "rest-sets", few)
    more = scratch.save(verified(near, sets, percent), "rest-links", max(few, scratch.parts("rest-sets")))

    whole = sketches.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("rep"), "signature", "bands")
    large = large.join(whole, "rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.ceil(F.col(n) / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1))
    told = ["rep", "label", "signature", "bands", "shingles"]
    asked = large.select("bucket", every("minors").alias("i"), at("size").alias("j"), F.lit(False).alias("asks"), *told)
    asking = large.where("minor").select("bucket", at("minors").alias("i"), every("size").alias("j"), F.lit(True).alias("asks"), *told)
    blocks = scratch.save(asked.union(asking).groupBy("bucket", "i", "j").applyInArrow(block_links(percent), "a long, b long").distinct(), "block-links")
    more = more.union(blocks)
    final = components(links.union(more), scratch, "all", few)
    scratch.drop("sketches", "starred", "rest-sets", "near", "left")

    out = members.join(final, members["rep"] == final["node"], "left")
    component = F.coalesce("label", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, percent: int = 80) -> DataFrame:
    """documents without the rows whose doc_id is not the smallest of its group; all columns stay as they are."""
    scratch = Scratch(documents.sparkSession, "minhash")
    groups = grouped(documents, scratch, percent)
    gone = scratch.save(groups.where("not kept").select("doc_id").distinct(), "gone", scratch.parts("members"))
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)


def query(documents: DataFrame) -> DataFrame:
    return grouped(documents, Scratch(documents.sparkSession, "minhash"), 85)


def sql() -> str:
    """DuckDB: all pairs that share a shingle, then components by a recursive walk to smaller ids."""
    return r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, array_to_string(w[i:i + 4], ' ') as sh from d, unnest(range(1, greatest(len(w) - 3, 2))) as u(i) where len(w) > 0 group by all),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as seen from documents union select r.node, e.b from r join e on e.a = r.seen)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, k.c as component_id, d.doc_id = k.c as kept
from d left join n using (doc_id) join (select node, min(seen) as c from r group by node) k on k.node = d.doc_id"""
