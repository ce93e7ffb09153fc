"""Snapshots: ancestry, selection and catalogs."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.session import Scratch

#: Snapshots that a catalog may hold.
DEEPEST = 65_536


class MissingBase(ValueError):
    """A snapshot's chain leads to a base that no stream holds."""


def chain(snapshots: DataFrame, target: int) -> DataFrame:
    """The rows (idx, to_guid, from_guid) that lead to the snapshot at idx `target`, with depth 0 for it and more for
    its bases. A base is the nearest row before with that to_guid; 0 has none. A missing base is a MissingBase.

    A stream's snapshots are DEEPEST at most, which is checked: the walk is done on the driver.
    """
    rows = snapshots.select("idx", "to_guid", "from_guid").limit(DEEPEST + 1).collect()
    if len(rows) > DEEPEST:
        raise ValueError(f"more than {DEEPEST} snapshots")
    by_idx = {r["idx"]: r for r in rows}
    if target not in by_idx:
        raise ValueError(f"no snapshot {target}")
    places: dict[int, list[int]] = {}
    for r in sorted(rows):
        places.setdefault(r["to_guid"], []).append(r["idx"])
    found = [by_idx[target]]
    while found[-1]["from_guid"]:
        last = found[-1]
        earlier = places.get(last["from_guid"], [])
        k = bisect_left(earlier, last["idx"])
        if not k:
            raise MissingBase(f"the base snapshot 0x{last['from_guid'] & (1 << 64) - 1:016x} is missing")
        found.append(by_idx[earlier[k - 1]])
    told = [(r["idx"], r["to_guid"], r["from_guid"], depth) for depth, r in enumerate(found)]
    return snapshots.sparkSession.createDataFrame(told, "idx long, to_guid long, from_guid long, depth long")


def nearest_bases(snapshots: DataFrame) -> DataFrame:
    """child, base: the idx of each snapshot's nearest earlier base; null where it has none in the table."""
    c, b = snapshots.alias("c"), snapshots.alias("b")
    pairs = c.join(b, (F.col("b.to_guid") == F.col("c.from_guid")) & (F.col("b.idx") < F.col("c.idx")), "left")
    return pairs.groupBy(F.col("c.idx").alias("child")).agg(F.max("b.idx").alias("base"))


def selected(snapshots: DataFrame, selectors: DataFrame) -> DataFrame:
    """For each selector: the idx it selects, its rank (1 full name, 2 short name, 3 guid) and matches in that rank.

    snapshots: idx, name (dataset@snapshot), to_guid. A rank counts if it has one match; names that match several
    times fall through to the next rank. idx is null where no rank has exactly one.
    """
    short = F.substring_index("name", "@", -1)
    wanted = F.regexp_replace("selector", "^@", "")
    asked = selectors.select("selector", wanted.alias("wanted"), text.parsed_guid(F.col("selector")).alias("guid")).distinct()
    told = snapshots.select("idx", "name", short.alias("short"), "to_guid")
    ways = [("selector", "name"), ("wanted", "short"), ("guid", "to_guid")]
    parts = [asked.join(told, F.col(a) == F.col(b)).select("selector", F.lit(k).alias("rank"), "idx") for k, (a, b) in enumerate(ways, 1)]
    hits = parts[0].union(parts[1]).union(parts[2])
    per = hits.groupBy("selector", "rank").agg(F.count(F.lit(1)).alias("matches"), F.min("idx").alias("idx")).where("matches = 1")
    best = per.groupBy("selector").agg(F.min_by(F.struct("idx", "rank"), "rank").alias("best")).select("selector", "best.idx", "best.rank")
    return selectors.select("selector").distinct().join(best, "selector", "left")


#: Levels and entries that a tree may have.
TREE_DEPTH, TREE_ENTRIES = 256, 1_000_000


class TreeTooLarge(ValueError):
    """A tree beyond the depth or the entries allowed, or one that leads back into itself."""


def descent(parents: DataFrame, node: str, parent: str, name: str, root: int | str, depth: int = TREE_DEPTH, entries: int | None = None) -> DataFrame:
    """node, path, depth of everything below a root in a table of (node, parent, name), a level at a time.

    Each level is one join of the written level before with the table, so that plans stay short; more levels or
    entries than allowed raise TreeTooLarge, which also ends a walk in a circle.
    """
    scratch = Scratch(parents.sparkSession, "descent")
    table = parents.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(name).alias("name"))
    start = table.where(F.col("parent") == F.lit(root))
    level = scratch.save(start.select("node", F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth")), "level-1")
    total, k, walked = 0, 1, []
    while n := level.count():
        total += n
        if k > depth:
            raise TreeTooLarge(f"more than {depth} levels below {root}")
        if entries is not None and total > entries:
            raise TreeTooLarge(f"more than {entries} entries below {root}")
        walked.append(level)
        k += 1
        below = level.select(F.col("node").alias("parent"), F.col("path").alias("up")).join(table, "parent")
        level = scratch.save(below.select("node", F.concat_ws("/", "up", "name").alias("path"), F.lit(k).alias("depth")), f"level-{k}")
    out = level
    for part in walked:
        out = out.union(part)
    return out


def latest_rows(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("rn = 1").drop("rn")


def inherited(nodes: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """nodes (node, parent, value; a row per node): where value is null, the nearest ancestor's, however far up.

    An open node points at an ancestor and takes over its value, or what it points at in turn, so that each round
    doubles the steps. Nodes that are still open after as many steps as there are nodes are in, or under, a loop: null.
    """
    scratch = Scratch(nodes.sparkSession, "inherited")
    done = scratch.save(nodes.select(F.col(node).alias("node"), F.col(value).alias("value"), F.col(parent).alias("up")), "round-0")
    rounds = done.count().bit_length()  # 2^rounds is more than the nodes
    for k in range(1, rounds + 1):
        open_ = done.where("value is null and up is not null")
        if open_.limit(1).count() == 0:
            break
        above = done.select(F.col("node").alias("up"), F.col("value").alias("above"), F.col("up").alias("further"))
        stepped = open_.join(above, "up", "left").select("node", F.col("above").alias("value"), F.col("further").alias("up"))
        done = scratch.save(done.where("value is not null or up is null").union(stepped), f"round-{k}")
        scratch.drop(f"round-{k - 1}")
    return done.select(F.col("node").alias(node), F.col("value").alias(value))
