"""Language identification by nearest centroid.

A text is the vector of its hashed byte n-grams (1 to 3 bytes of the lower-cased text, anything but letters as a
space), as log counts times the n-grams' inverse document frequency, at length 1. Each language has several centroids,
from spherical k-means over its own labelled texts; a text takes the language of the centroid with the largest cosine,
and is rejected where that cosine is far below those of the texts the centroid was made from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shingles import BLOCK, bytes_of, in_pieces, lean, word_hashes

DIMS = 4096
#: Texts whose vectors are worked out at once: 4 MB of counts.
ROWS = 256
#: The model is fitted on about this many labelled texts, shared equally among the languages, twice that at most.
SAMPLE = 3000
CLUSTERS = 4
#: Clusters with less than this share of a language's texts are outliers and give no centroid.
LEAST = 0.01
#: A text is rejected below this share of the cosine that 99 % of a centroid's own texts reach. At sf0.1 junk and code
#: come to 0.22 of it at most; 99.7 % of 4,000 documents come to 0.77 at least.
REJECT = 0.5
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray


def features(column: pa.Array) -> np.ndarray:
    """Counts (rows x DIMS, float32) of hashed n-grams; whole texts, a block at a time."""
    data, at = bytes_of(pc.utf8_lower(column.cast(pa.large_string())))
    byte = np.arange(256)
    fold = np.where(((byte >= 97) & (byte <= 122)) | (byte >= 128), byte, 32).astype(np.uint32)
    out = np.zeros((len(at) - 1, DIMS), np.float32)
    for r, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for b in range(lo, hi, BLOCK):
            x = fold[data[b : min(hi, b + BLOCK + 2)]]  # two more, so that n-grams over the edge count
            n = min(hi - b, BLOCK)
            grams = [x[:n], (x[:-1] | x[1:] << np.uint32(8) | np.uint32(1 << 24))[:n]]
            if len(x) > 2:
                grams.append((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16) | np.uint32(1 << 25))[:n])
            hashed = (np.concatenate(grams) * np.uint32(0x9E3779B1)) >> np.uint32(20)
            out[r] += np.bincount(hashed, minlength=DIMS)
    return out


def word_features(column: pa.Array) -> np.ndarray:
    """Counts (rows x DIMS, float32) of hashed words; whole texts."""
    words, at = word_hashes(*bytes_of(column))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = row * DIMS + (words >> np.uint64(52)).astype(np.int64)
    return np.bincount(place, minlength=(len(at) - 1) * DIMS).astype(np.float32).reshape(-1, DIMS)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """counts, float32, turned in place into vectors of length 1 (or 0), a slice of rows at a time."""
    for lo in range(0, len(counts), 64):
        x = counts[lo : lo + 64]
        np.log1p(x, out=x)
        x *= idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x /= np.where(norm > 0, norm, 1)
    return counts


def clustered(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids at length 1 of k clusters at most: from the mean's nearest row, then rows drawn by their distance to
    the centroids so far (k-means++, the same on every run), then Lloyd's rounds. Clusters of outliers are dropped."""
    chosen, draw = [int(np.argmax(x @ x.mean(axis=0)))], np.random.default_rng(7)
    for _ in range(min(k, len(x)) - 1):
        far = np.clip(1 - (x @ x[chosen].T).max(axis=1).astype(np.float64), 0, None)
        if far.max() < 0.001:
            break
        chosen.append(int(draw.choice(len(x), p=far / far.sum())))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return c[np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c)) >= max(1, LEAST * len(x))]


Features = Callable[[pa.Array], np.ndarray]


def counted_batches(counts_of: Features) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, lang, text) to (doc_id, lang, places, counts): counts that are not 0, as 16-bit places and
    float32 bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 2, rows=ROWS):
                found = counts_of(piece.column(2))
                places = [np.flatnonzero(x).astype(np.uint16) for x in found]
                counts = [x[p].tobytes() for x, p in zip(found, places, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([p.tobytes() for p in places], pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "lang", "places", "counts"])

    return work


def fit(labelled: DataFrame, sample: int = SAMPLE, features: Features = features) -> Model | None:
    """A model from rows (doc_id long, lang, text); those without a lang or text count for nothing.

    Texts are sampled by a hash of doc_id: about `sample` in all, at most twice that, in equal shares by language (a
    rarer language gives all it has). Only their counts, of fixed size, reach the driver. None without any text. The
    `sample` most frequent languages are learnt, of equally frequent ones the first by name. Rows that repeat count
    each; of equal cosines the first centroid wins, in the order of the languages' names.
    """
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    share = max(1, sample // len(sizes))
    ranked = (F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("u")
    most = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, share / n))])
    taken = rows.where(ranked < F.element_at(most, F.col("lang"))).mapInArrow(lean(counted_batches(features)), "doc_id long, lang string, places binary, counts binary")
    got = sorted(taken.limit(2 * sample).collect(), key=lambda r: (r["lang"], r["doc_id"]))
    if not got:
        return None
    counts = np.zeros((len(got), DIMS), np.float32)
    for k, r in enumerate(got):
        counts[k, np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    tags = np.array([r["lang"] for r in got])
    del got
    idf = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32)
    x = weighed(counts, idf)
    langs = sorted(set(tags.tolist()))
    owner, centroids, floor = [], [], []
    for i, lang in enumerate(langs):
        own = x[tags == lang]
        c = clustered(own, CLUSTERS)
        near = own @ c.T
        for k in range(len(c)):
            mine = near[np.argmax(near, axis=1) == k, k]
            owner.append(i)
            centroids.append(c[k])
            floor.append(REJECT * float(np.quantile(mine, 0.01)) if len(mine) else 0.0)
    return Model(langs, np.array(owner), np.stack(centroids).astype(np.float32), idf, np.array(floor))


def judged(model: Model | None, texts: pa.Array, lettered: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and acceptance of each text; without a letter (or a model) unknown, 0 and rejected."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    near = weighed(features(texts), model.idf) @ model.centroids.T
    best = np.argmax(near, axis=1) if len(near) else np.zeros(0, int)
    score = np.clip(near[np.arange(len(near)), best].astype(np.float64), 0, 1) * lettered
    langs = [model.langs[i] if ok else UNKNOWN for i, ok in zip(model.owner[best].tolist(), lettered.tolist(), strict=True)]
    return langs, score, lettered & (score >= model.floor[best])


def clusters(model: Model | None, lang: Column, text: Column) -> Column:
    """The number, as a string, of the nearest by word_features of a language's centroids, `-` if it has none. Only the
    language and the text of a row go to Python."""

    def near(langs: pa.Array, texts: pa.Array) -> pa.Array:
        index = {x: i for i, x in enumerate(model.langs)} if model else {}
        own = np.array([index.get(x, -1) for x in langs.to_pylist()], np.int64)
        out = np.full(len(own), "-", object)
        at = 0
        for piece in in_pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, rows=ROWS):
            mine = own[at : at + piece.num_rows]
            if (mine >= 0).any():
                cosine = weighed(word_features(piece.column(0)), model.idf) @ model.centroids.T
                cosine[model.owner[None, :] != mine[:, None]] = -np.inf
                best = np.argmax(cosine, axis=1) - np.searchsorted(model.owner, mine)
                out[at : at + len(mine)] = np.where(mine >= 0, best.astype(str).astype(object), "-")
            at += piece.num_rows
        return pa.array(out.tolist(), pa.string())

    return F.arrow_udf(near, "string")(lang, text.cast("string"))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predicted(texts: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for rows (doc_id long, text); null and letterless texts are unknown."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1, rows=ROWS):
                langs, score, ok = judged(model, piece.column(1), piece.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(ok)], names=["doc_id", "lang_pred", "score", "accepted"])

    return texts.select("doc_id", "text", has_letter(F.col("text")).alias("lettered")).mapInArrow(lean(work), "doc_id long, lang_pred string, score double, accepted boolean")


def accepting(df: DataFrame, model: Model | None) -> DataFrame:
    """The rows of df whose text (column `text`) the model accepts, all columns as they are, whatever their names. No
    model accepts all. Only the text of a row goes to Python."""
    if model is None:
        return df

    def fine(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        both = pa.RecordBatch.from_arrays([texts, lettered], names=["text", "lettered"])
        parts = [judged(model, p.column(0), p.column(1).to_numpy(zero_copy_only=False))[2] for p in in_pieces(both, 0, rows=ROWS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    text = df["text"].cast("string")
    return df.where(F.arrow_udf(fine, "boolean")(text, has_letter(text)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnt_from(documents: DataFrame) -> Model | None:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return fit(rows.where(~held_out(F.col("doc_id"))))


def query(documents: DataFrame) -> DataFrame:
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = predicted(texts, learnt_from(documents))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
