"""Last-writer-wins replay of interval logs as joins, windows and aggregates.

A log has one row per change: seq (its order), object, kind (OBJECT, WRITE, FREE, FREEOBJECTS), lo and hi (bytes; hi is
null where a free runs to the end). Nothing here reads payloads: a segment names the write that it shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def forward_filled(df: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """df with `column` at nulls taking the last value before them in its partition."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def generations(log: DataFrame, object_type: str | None = None) -> DataFrame:
    """log with `generation` per object: it grows where an object is freed, or defined anew with another type.

    Defining it again with the type it has keeps the generation; only rows of the last one are live.
    """
    w = Window.partitionBy("object").orderBy("seq")
    reset = F.col("kind") == "FREEOBJECTS"
    if object_type:
        before = F.last(F.when(F.col("kind") == "OBJECT", F.col(object_type)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        reset = reset | F.coalesce((F.col("kind") == "OBJECT") & (before != F.col(object_type)), F.lit(False))
    return log.withColumn("generation", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def live(log: DataFrame, object_type: str | None = None) -> DataFrame:
    """Rows of each object's last generation: from its last free, or definition with another type, on.

    Only rows that free or define objects, a few for each snapshot, pass through a window; all others meet the place of
    their object's last reset by a join, which Spark can split where one object has very many.
    """
    few = generations(log.where(F.col("kind").isin("OBJECT", "FREEOBJECTS")), object_type)
    resets = few.groupBy("object", "generation").agg(F.min("seq").alias("seq")).where("generation > 0").groupBy(F.col("object").alias("reset_object")).agg(F.max("seq").alias("reset_at"))
    both = log.join(resets, F.col("object") == F.col("reset_object"), "left")
    return both.where("reset_at is null or seq >= reset_at").drop("reset_object", "reset_at")


def covering(objects: DataFrame, ranges: DataFrame, latest: bool = False) -> DataFrame:
    """(object, seq) for each distinct object and each range (seq, first_object, count) that covers it; if only the
    latest are asked for, perhaps some others too.

    Ranges are cut into aligned blocks of 2^level objects, two a level at most, so that they meet objects on a key
    however long they are.
    """
    r = ranges.where("count > 0").select("seq", F.col("first_object").cast("long").alias("lo"), (F.col("first_object") + F.col("count")).cast("long").alias("stop"))
    r = r.withColumn("level", F.explode(F.expr("sequence(0, length(bin(stop - lo)) - 1)")))
    r = r.withColumn("a", F.expr("-shiftright(-lo, level)")).withColumn("b", F.expr("shiftright(stop, level)")).where("a < b")
    ends = F.array(F.when(F.col("a") % 2 != 0, F.col("a")), F.when(F.col("b") % 2 != 0, F.col("b") - 1))
    blocks = r.withColumn("block", F.explode(F.filter(ends, lambda x: x.isNotNull()))).groupBy("level", "block", *([] if latest else ["seq"])).agg(F.max("seq").alias("top")).select("level", "block", F.col("top").alias("seq"))
    levels = blocks.select("level").distinct()  # a row per level, 64 at most
    placed = objects.select("object").distinct().crossJoin(F.broadcast(levels)).withColumn("block", F.expr("shiftright(cast(object as bigint), level)"))
    return placed.join(blocks, ["level", "block"]).select("object", "seq")


def expanded_frees(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of log without those that a later range of freed objects covers; ranges: seq, first_object, count. An
    object is freed by the latest of the ranges that cover it."""
    freed = covering(log, ranges, latest=True).groupBy(F.col("object").alias("freed")).agg(F.max("seq").alias("freed_at"))
    return log.join(freed, (F.col("object") == F.col("freed")) & (F.col("seq") < F.col("freed_at")), "left_anti")


def segments(log: DataFrame, grain: int = 1 << 20) -> DataFrame:
    """The map that is left after replay: object, lo, hi, seq, begins (where that write began), in disjoint rows.

    A boundary sweep: bounds of an object's changes cut it into elementary pieces, each of which shows the latest
    change that covers it; frees leave no row, and neighbours that show the same write are joined again. Rows of kinds
    other than WRITE and FREE are ignored: pass live(log) where objects are redefined. Of changes with equal seq the
    write wins.

    Everything is done within grains of an object, which changes are cut at, so that one long file is dealt over many
    tasks. Frees to the end touch no grain: only in objects that have any, a running maximum over the grains, a row
    each, carries the latest of them on.
    """
    changes = log.where(F.col("kind").isin("WRITE", "FREE")).select("object", "seq", "kind", "lo", "hi").where("hi is null or lo < hi")
    dealt = changes.where("hi is not null").withColumn("grain", F.explode(F.sequence(F.expr(f"lo div {grain}"), F.expr(f"(hi - 1) div {grain}"))))
    dealt = dealt.withColumn("a", F.greatest("lo", F.col("grain") * grain)).withColumn("b", F.least("hi", (F.col("grain") + 1) * grain))
    ends = changes.where("hi is null").select("object", F.expr(f"lo div {grain}").alias("grain"), F.col("lo").alias("at"), F.col("seq").alias("freed"))
    none = F.lit(None).cast("long").alias("freed")
    cuts = dealt.select("object", "grain", F.col("a").alias("at"), none).union(dealt.where(F.col("b") < (F.col("grain") + 1) * grain).select("object", "grain", F.col("b").alias("at"), none)).union(ends)
    cuts = cuts.groupBy("object", "grain", "at").agg(F.max("freed").alias("freed"))
    within = Window.partitionBy("object", "grain").orderBy("at")
    to = F.coalesce(F.lead("at").over(within), (F.col("grain") + 1) * grain)
    pieces = cuts.select("object", "grain", "at", to.alias("to"), F.max("freed").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("here"))

    per = dealt.select("object", "grain").join(ends.select("object").distinct(), "object", "left_semi").select("object", "grain", none).union(ends.select("object", "grain", "freed"))
    before = Window.partitionBy("object").orderBy("grain").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.groupBy("object", "grain").agg(F.max("freed").alias("freed")).select("object", "grain", F.max("freed").over(before).alias("before")).where("before is not null")
    pieces = pieces.join(carried, ["object", "grain"], "left").select("object", "grain", "at", "to", F.greatest("here", "before").alias("freed"))

    met = pieces.join(dealt, ["object", "grain"]).where("a <= at and b >= to")
    top = met.groupBy("object", "at", "to", "freed").agg(F.max(F.struct("seq", F.col("kind").alias("kind"), F.col("lo").alias("begins"))).alias("top"))
    kept = top.where("top.kind = 'WRITE' and (freed is null or top.seq >= freed)")
    return merged(kept.select("object", F.col("at").alias("lo"), F.col("to").alias("hi"), "top.seq", "top.begins"))


def merged(pieces: DataFrame) -> DataFrame:
    """Neighbouring pieces of one write joined. Each write is for itself, so windows are as small as writes."""
    w = Window.partitionBy("object", "seq").orderBy("lo")
    new = ~(F.lag("hi").over(w) == F.col("lo"))
    runs = pieces.withColumn("fresh", F.coalesce(new, F.lit(True))).withColumn("run", F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("object", "seq", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("begins").alias("begins")).select("object", "lo", "hi", "seq", "begins")


def positioned_reads(windows: DataFrame, segs: DataFrame, grain: int) -> DataFrame:
    """Pieces of segments that read windows (object, window, lo, hi) cover: object, window, lo, hi, seq.

    Both sides are dealt by the grains that they touch; a piece is kept in the grain that its start lies in.
    """
    grains = lambda df: df.withColumn("grain", F.explode(F.sequence(F.expr(f"lo div {grain}"), F.expr(f"(hi - 1) div {grain}"))))
    a, b = grains(windows.where("lo < hi")).alias("a"), grains(segs.where("lo < hi")).alias("b")
    both = a.join(b, (F.col("a.object") == F.col("b.object")) & (F.col("a.grain") == F.col("b.grain")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi")))
    lo, hi = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    return both.where(F.floor(lo / grain) == F.col("a.grain")).select(F.col("a.object").alias("object"), "a.window", lo.alias("lo"), hi.alias("hi"), "b.seq")


def last_writers(log: DataFrame, block: int) -> DataFrame:
    """object, block, seq: the latest write of each block that any write touches."""
    w = log.where("kind = 'WRITE' and lo < hi").withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    return w.groupBy("object", "block").agg(F.max("seq").alias("seq"))


def latest(log: DataFrame, kind: str, *columns: str) -> DataFrame:
    """One row per object: the given columns of its last row of a kind."""
    return log.where(F.col("kind") == kind).groupBy("object").agg(F.max_by(F.struct("seq", *columns), "seq").alias("top")).select("object", "top.*")
