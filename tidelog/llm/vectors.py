"""Near-duplicate vectors by flat proximity graphs with robust pruning.

1. Vectors are scaled to length 1 in double precision; equal ones form a class that one of them stands for.
2. Centroids, fitted on a bounded sample, part all representatives into overlapping clusters: each goes to its nearest
   few. A cluster that is far too large is parted again, by centroids of its own, as often as it takes, so that
   shards keep their size however many vectors there are. What cannot be parted, since its vectors lie close
   together, is dealt into blocks, and every pair of blocks is a shard.
3. Each shard builds a graph: from a random start, greedy searches from the medoid find each vector's surroundings,
   and robust pruning keeps edges in different directions.
4. Adjacency lists of the same vector from different shards are united, and go back to all its shards.
5. In every shard each vector searches greedily from the medoid, then expands from what lies within the range to its
   neighbours until nothing new does. Cosines are verified in double precision.
6. Recall is audited against brute force for a bounded sample of vectors; where it is too low, the whole search is done
   again with more overlap, and at last with all vectors as one cluster, so that every pair meets in some shard.

Only counts, local union-find trees and audits leave a shard, never all its pairs: a pair is counted in the one shard
that owns it, the first that holds both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.shingles import lean
from tidelog.session import Scratch

#: Members of a shard on average, and those beyond which a cluster is dealt into blocks of half as many.
SHARD, MOST = 256, 384
CENTROIDS = 2048
#: Members beyond which a cluster is parted again, levels at most, and members of it that its centroids are fitted on.
SPLIT, LEVELS, FITTED = 8 * MOST, 4, 8192
#: Clusters whose vectors have this cosine with their mean, on average, are not parted; centroids this near are one.
TIGHT = 0.95
#: Vectors, and bytes, that centroids are fitted on at most.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
DEGREE, BEAM, ALPHA = 16, 24, 1.2
#: Vectors that are audited; the recall that is worked for, and the least that is accepted.
AUDIT, RECALL, LEAST_RECALL = 256, 0.95, 0.9


def unit_batches(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (vec_id, embedding) to (vec_id, unit): doubles at length 1 as bytes; null for vectors that link with nothing.

    Shorter vectors are compared as if zeros stood at their ends.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.list_(pa.float64()))
            units = []
            for value in column:
                x = None if value.as_py() is None else value.values.to_numpy(zero_copy_only=False)  # nulls become NaN
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    units.append(None)
                    continue
                x = x / np.abs(x).max()  # no square of it overflows or vanishes
                units.append(np.pad(x / np.sqrt(x @ x), (0, width - len(x))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "unit"])

    return work


def matrix(units: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = units.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def centroids_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids at length 1 of x by spherical k-means; the first ones are spread over x in its order."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], first)
        norm = np.sqrt((sums * sums).sum(axis=1))
        fine = norm > 0
        c[there[fine]] = sums[fine] / norm[fine, None]
    return c


def assigned_batches(centroids: np.ndarray, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (rep, unit) to (rep, leaf): a row for each of the nearest `overlap` centroids, by their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                top = nearest(matrix(batch.column(1)), centroids, overlap)
                reps = np.repeat(batch.column(0).to_numpy(), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(top.ravel().astype(np.int64))], names=["rep", "leaf"])

    return work


def nearest(x: np.ndarray, centroids: np.ndarray, overlap: int) -> np.ndarray:
    m = min(overlap, len(centroids))
    return np.argpartition(-(x @ centroids.T), m - 1, axis=1)[:, :m]


def fit_children(overlap: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """From a sample (leaf, size, unit) of a cluster to its row (leaf, centroids); none if it cannot be parted."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table["unit"])
        mean = x.mean(axis=0)
        size = table["size"][0].as_py()
        found = []
        if np.sqrt(mean @ mean) < TIGHT:
            for c in centroids_of(x, min(CENTROIDS, -(-overlap * size // SHARD), max(2, len(x) // 8))):
                if not found or (np.stack(found) @ c).max() < TIGHT:
                    found.append(c)
        some = len(found) > 1
        return pa.table({"leaf": pa.array([key[0].as_py()] * some, pa.int64()), "centroids": pa.array([np.stack(found).tobytes()] if some else [], pa.binary())})

    return work


def child_of(overlap: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Deals a chunk of a cluster's members (leaf, chunk, rep, unit) to its children by their centroids."""

    def work(key: tuple, members: pa.Table, parted: pa.Table) -> pa.Table:
        if not len(members) or not len(parted):
            return pa.table({"rep": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64())})
        x = matrix(members["unit"])
        centroids = np.frombuffer(parted["centroids"][0].as_py(), np.float64).reshape(-1, x.shape[1])
        top = nearest(x, centroids, overlap)
        leaf = (key[0].as_py() + 1) * CENTROIDS + top
        return pa.table({"rep": pa.array(np.repeat(members["rep"].to_numpy(), top.shape[1])), "leaf": pa.array(leaf.ravel().astype(np.int64))})

    return work


def parted(reps: DataFrame, pairs: DataFrame, overlap: int, width: int, scratch: Scratch, name: str) -> DataFrame:
    """pairs (rep, leaf) with every leaf that is far too large parted again, level by level, until none is or none can.

    A leaf's children are numbered (leaf + 1) * CENTROIDS and on, so that numbers of all levels differ. Fitting takes
    FITTED sampled members of a leaf, or fewer of wide vectors, and one task; dealing takes as many tasks as it has chunks.
    """
    fitted = max(64, min(FITTED, SAMPLE_BYTES // (8 * width)))
    done: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        sizes = scratch.save(pairs.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SPLIT), f"{name}-sizes-{level}")
        if sizes.limit(1).count() == 0:
            break
        chance = F.xxhash64("rep", F.lit(31 + level)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        large = pairs.join(sizes, "leaf")
        sample = large.where(chance < fitted / F.col("size")).join(reps.select("rep", "unit"), "rep").select("leaf", "size", "unit")
        told = scratch.save(sample.groupBy("leaf").applyInArrow(fit_children(overlap), "leaf long, centroids binary"), f"{name}-centroids-{level}")
        if told.limit(1).count() == 0:
            break
        chunks = F.ceil(F.col("size") / fitted).cast("int")
        going = large.join(told.select("leaf"), "leaf").join(reps.select("rep", "unit"), "rep").select("leaf", F.pmod(F.xxhash64("rep", F.lit(3)), chunks).cast("int").alias("chunk"), "rep", "unit")
        rows = told.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "centroids")
        below = going.groupBy("leaf", "chunk").cogroup(rows.groupBy("leaf", "chunk")).applyInArrow(child_of(overlap), "rep long, leaf long")
        below = scratch.save(below, f"{name}-level-{level}")
        done.append(pairs.join(told.select("leaf"), "leaf", "left_anti").select("rep", "leaf"))
        pairs = below
    for part in done:
        pairs = pairs.union(part)
    return pairs


def greedy(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all queries at once: (ids, cosines), `beam` wide, nearest first; ids of -1 are empty.

    graph holds each vector's neighbours, padded with its own number. Each round every query expands the best of its
    beam that is not expanded yet, until none has any.
    """
    n, q = len(x), len(queries)
    beam = min(beam, n)
    seen = np.zeros((q, n), bool)
    ids = np.full((q, beam), -1, np.int64)
    near = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    ids[:, 0], near[:, 0], done[:, 0], seen[:, start] = start, queries @ x[start], False, True
    going = np.arange(q)
    while len(going):
        best = np.argmax(np.where(done[going], -np.inf, near[going]), axis=1)
        node = ids[going, best]
        done[going, best] = True
        around = graph[node]
        fresh = ~seen[going[:, None], around]
        seen[going[:, None], around] = True
        cosine = np.where(fresh, np.einsum("gd,grd->gr", queries[going], x[around]), -np.inf)
        # a number that stands twice in a list counts once
        order = np.argsort(around, axis=1, kind="stable")
        again = np.zeros_like(fresh)
        ordered = np.take_along_axis(around, order, axis=1)
        np.put_along_axis(again, order, np.concatenate([np.zeros((len(going), 1), bool), ordered[:, 1:] == ordered[:, :-1]], axis=1), axis=1)
        cosine[again] = -np.inf
        all_ids = np.concatenate([ids[going], np.where(cosine > -np.inf, around, -1)], axis=1)
        all_near = np.concatenate([near[going], cosine], axis=1)
        all_done = np.concatenate([done[going], cosine == -np.inf], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[going], near[going], done[going] = (np.take_along_axis(v, top, axis=1) for v in (all_ids, all_near, all_done))
        going = going[(~done[going]).any(axis=1)]
    return ids, near


def pruned(x: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for all vectors at once: of each one's candidates (numbers, -1 for none) at most `degree`.

    The nearest is kept; candidates that are nearer to it, by the factor alpha, than to the vector itself go; again.
    Distances are squares of chords. Places that stay empty hold the vector's own number.
    """
    n = len(x)
    own = np.arange(n)
    out = np.repeat(own[:, None], degree, axis=1)
    valid = (candidates >= 0) & (candidates != own[:, None])
    c = np.where(valid, candidates, own[:, None])
    points = x[c]
    away = np.where(valid, 2 - 2 * np.einsum("nd,ncd->nc", x, points), np.inf)
    for k in range(degree):
        best = np.argmin(away, axis=1)
        has = away[own, best] < np.inf
        if not has.any():
            break
        chosen = c[own, best]
        out[has, k] = chosen[has]
        between = 2 - 2 * np.einsum("nd,ncd->nc", x[chosen], points)
        away = np.where(alpha * between <= away, np.inf, away)
        away[own, best] = np.inf
    return out


def with_reverse(graph: np.ndarray, room: int) -> np.ndarray:
    """Each vector's list, and up to `room` vectors that list it, padded with -1."""
    n, degree = graph.shape
    source, target = np.repeat(np.arange(n), degree), graph.ravel()
    real = source != target
    source, target = source[real], target[real]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < room
    back = np.full((n, room), -1, np.int64)
    back[target[fits], place[fits]] = source[fits]
    return np.concatenate([graph, back], axis=1)


def built(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The pruned graph of a shard (numbers, padded with each vector's own) and its medoid."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    graph = np.random.default_rng(n).integers(0, n, (n, min(degree, max(1, n - 1))))
    for a in (1.0, alpha):
        found, _ = greedy(x, graph, medoid, x, beam)
        graph = pruned(x, np.concatenate([found, graph], axis=1), degree, a)
        graph = pruned(x, with_reverse(graph, 3 * degree), degree, a)
    return graph, medoid


CELL = ["cluster", "i", "j"]


def build_shard(key: tuple, table: pa.Table) -> pa.Table:
    """(rep, around): the members' numbers in the corpus, and those of their neighbours."""
    x, ids = matrix(table["unit"]), table["rep"].to_numpy()
    graph, _ = built(x) if len(x) > 1 else (np.zeros((len(x), 1), np.int64), 0)
    around = [np.unique(ids[g[g != r]]) for r, g in enumerate(graph)]
    return pa.table({"rep": pa.array(ids), "around": pa.array(around, pa.list_(pa.int64()))})


def in_range(x: np.ndarray, graph: np.ndarray, start: int, least: float) -> np.ndarray:
    """Which pairs (a square of flags) of different vectors range-expanding search finds at a cosine of `least`."""
    n = len(x)
    ids, near = greedy(x, graph, start, x, BEAM)
    found, tried = np.zeros((n, n), bool), np.zeros((n, n), bool)
    q, k = np.nonzero((near >= least) & (ids >= 0))
    found[q, ids[q, k]] = tried[q, ids[q, k]] = True
    front = (q, ids[q, k])
    while len(front[0]):
        q = np.repeat(front[0], graph.shape[1])
        node = graph[front[1]].ravel()
        fresh = ~tried[q, node]
        flat = np.unique(q[fresh] * n + node[fresh])
        q, node = flat // n, flat % n
        tried[q, node] = True
        hit = np.concatenate([np.einsum("kd,kd->k", x[q[i : i + 65536]], x[node[i : i + 65536]]) >= least for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0, bool)
        front = (q[hit], node[hit])
        found[front] = True
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def search_shard(least: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """(rep, links, root): links of pairs that this shard owns, weighted by copies, and the least rep linked here."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        cluster, i, j = (k.as_py() for k in key)
        x, ids = matrix(table["unit"]), table["rep"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        n = len(ids)
        take = lambda name: table[name].take(pa.array(order))
        copies, block = take("copies").to_numpy(), take("block").to_numpy()
        around = take("around").combine_chunks()
        members = np.repeat(np.arange(n), np.diff(around.offsets.to_numpy()))
        numbers = around.values.to_numpy()[around.offsets[0].as_py() : around.offsets[-1].as_py()] if len(members) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(ids, numbers), n - 1)
        here = ids[place] == numbers  # united lists name vectors of other shards too
        members, place = members[here], place[here]
        degree = np.bincount(members, minlength=n)
        graph = np.repeat(np.arange(n)[:, None], max(1, degree.max(initial=1)), axis=1)
        graph[members, np.arange(len(members)) - np.repeat(np.cumsum(degree) - degree, degree)] = place
        found = in_range(x, graph, int(np.argmax(x @ x.mean(axis=0))), least)
        found[ids[:, None] == ids[None, :]] = False
        # the first cluster that holds both vectors owns their pair, and within it the shard of their two blocks
        told = take("clusters").to_pylist()
        lists = np.full((n, max(map(len, told))), -1, np.int64)
        for r, own in enumerate(told):
            lists[r, : len(own)] = own
        a, b = np.nonzero(found)
        both = ((lists[a][:, :, None] == lists[b][:, None, :]) & (lists[a] >= 0)[:, :, None]).any(axis=2)
        first = np.where(both, lists[a], np.iinfo(np.int64).max).min(axis=1) if len(a) else np.zeros(0, np.int64)
        owns = (first == cluster) & ((i == j) | (block[a] != block[b]))
        links = np.bincount(a[owns], weights=copies[b[owns]], minlength=n).astype(np.int64)
        root = np.arange(n)
        while True:  # least number over links, then over its own root, until all agree
            low = root.copy()
            np.minimum.at(low, a, root[b])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pa.table({"rep": pa.array(ids), "links": pa.array(links), "root": pa.array(ids[root])})

    return work


def audit_batches(units: np.ndarray, ids: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (rep, copies, unit) to (rep, expected): links of the audited vectors with the batch's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = (matrix(batch.column(2)) @ units.T >= least) & (batch.column(0).to_numpy()[:, None] != ids[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(batch.column(1).to_numpy() @ near.astype(np.int64))], names=["rep", "expected"])

    return work


def searched(reps: DataFrame, sizes: tuple[int, int], least: float, overlap: int | None, scratch: Scratch, name: str) -> DataFrame:
    """(rep, links, root) from every shard, for written rows reps (rep, unit, copies); sizes: their number and width.
    Without an overlap all vectors are one cluster."""
    n, width = sizes
    if overlap is None:
        pairs = reps.select("rep", F.lit(0).cast("long").alias("leaf"))
    else:
        share = min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * width)) / n)
        chance = F.xxhash64("rep", F.lit(11)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        sample = reps.where(chance < share).select("rep", "unit").limit(2 * SAMPLE).toArrow().sort_by("rep")
        centroids = centroids_of(matrix(sample["unit"]), min(CENTROIDS, -(-overlap * n // SHARD))) if len(sample) else np.eye(1, width)
        first = scratch.save(reps.select("rep", "unit").mapInArrow(lean(assigned_batches(centroids, overlap)), "rep long, leaf long"), f"{name}-first")
        pairs = parted(reps, first, overlap, width, scratch, name)
    pairs = scratch.save(pairs, f"{name}-pairs")
    large = scratch.save(pairs.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > MOST).select(F.col("leaf").alias("cluster"), F.ceil(F.col("size") / (MOST // 2)).cast("int").alias("blocks")), f"{name}-large")
    lists = pairs.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("clusters"))
    spread = scratch.save(reps.select("rep", "unit", "copies").join(lists, "rep"), f"{name}-spread")
    cells = spread.withColumn("cluster", F.explode("clusters")).join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a block meets itself in the shard of another block too, unless it is the only one
    cells = cells.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "unit", "copies", "clusters", "block")
    built_ = scratch.save(cells.select(*CELL, "rep", "unit").groupBy(*CELL).applyInArrow(build_shard, "rep long, around array<long>"), f"{name}-lists")
    united = scratch.save(built_.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around")), f"{name}-united")
    scratch.drop(f"{name}-lists", f"{name}-first")
    out = scratch.save(cells.join(united, "rep").groupBy(*CELL).applyInArrow(search_shard(least), "rep long, links long, root long"), name)
    scratch.drop(f"{name}-spread", f"{name}-united", f"{name}-pairs")
    return out


def audited(reps: DataFrame, found: DataFrame, n: int, least: float) -> float:
    """Links found over links there are, for about AUDIT vectors against all; 1 where there are none."""
    chance = F.xxhash64("rep", F.lit(23)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    asked = reps.where(chance < AUDIT / max(1, n)).select("rep", "unit").limit(2 * AUDIT).toArrow()
    if not len(asked):
        return 1.0
    ids = asked["rep"].to_numpy()
    there = reps.select("rep", "copies", "unit").mapInArrow(lean(audit_batches(matrix(asked["unit"]), ids, least)), "rep long, expected long")
    there = there.groupBy("rep").agg(F.sum("expected").alias("expected"))
    got = found.where(F.col("rep").isin(ids.tolist())).groupBy("rep").agg(F.sum("links").alias("links"))
    row = there.join(got, "rep", "left").agg(F.sum("expected").alias("expected"), F.sum(F.least(F.coalesce("links", F.lit(0)), "expected")).alias("links")).first()
    return row["links"] / row["expected"] if row["expected"] else 1.0


def linked(vectors: DataFrame, least: float = 0.9, recall: float = RECALL, overlap: int = 2) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept, recall.

    Vectors that are null, empty or zero, or hold a null or non-finite component, and rows without a vec_id, link with
    nothing. Rows that repeat are vectors of their own. recall is the audit's figure for the search that was taken:
    the first to reach the recall asked for, with up to eight times the overlap, else the one over all pairs of blocks.
    Where even that misses LEAST_RECALL it is an error. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    width = max(1, width or 1)
    units = scratch.save(rows.mapInArrow(lean(unit_batches(width)), "vec_id long, unit binary").withColumn("print", F.sha2("unit", 256)), "units")
    valid = units.where("unit is not null and vec_id is not null")
    classes = valid.groupBy("print").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    reps = scratch.save(classes, "reps")
    n = reps.count()
    reached, found, name = 1.0, None, ""
    for width_of in [overlap, 2 * overlap, 4 * overlap, 8 * overlap, None] if n else []:
        name = f"found-{width_of}"
        found = searched(reps, (n, width), least, width_of, scratch, name)
        reached = audited(reps, found, n, least)
        if reached >= recall:
            break
        if width_of is not None:
            scratch.drop(name)
    if reached < LEAST_RECALL:
        raise RuntimeError(f"a recall of {reached:.3f}")
    names = scratch.save(reps.select("print", "rep", "copies"), "names")
    scratch.drop("reps")
    member = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("print")).alias("print")).join(names, "print", "left")
    member = member.select("vec_id", "rep", F.coalesce("copies", F.lit(1)).alias("copies"))
    if found is None:
        return member.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    labels = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = scratch.save(links.join(labels, links["rep"] == labels["node"], "left").select("rep", "links", F.coalesce("label", "rep").alias("label")), "known")
    scratch.drop(name)
    out = member.join(known, "rep", "left")
    component = F.coalesce("label", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(reached)).alias("recall"))


def query(embeddings: DataFrame) -> DataFrame:
    return linked(embeddings)
