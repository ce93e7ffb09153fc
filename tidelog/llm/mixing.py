"""Mixing sources to target weights: raking token counts to marginals, then sampling by calibrated probabilities.

Documents fall into cells (one value per margin). Iterative proportional fitting scales the cells' inclusion
probabilities margin by margin until the expected tokens of every category meet its goal; a probability that would
pass 1 stays at 1 and the others of its category take up what it lacks, as far as they can. A document is then taken
where a hash of its id lies below its cell's probability: the same documents on every run, and a document taken at a
small probability is also taken at any larger one.

Margins are source, language and topic. Topics are learnt: clusters of TF-IDF vectors of words within each language
(module langid, on a bounded sample). They part their language's goal, so that the two margins never contradict.

Rows: null ids share one hash, equal ids are all taken or all left; null and unlisted categories are categories of
their own; null, empty and blank texts have no tokens, whole texts of any length are counted; columns that clash with
names used here are safe within the struct `row`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import langid
from tidelog.llm.rows import nested
from tidelog.session import Scratch

#: Category of rows whose value is null.
NONE = "(none)"
#: Raking ends after SWEEPS, or where BATCH sweeps change no probability by TOLERANCE.
SWEEPS, TOLERANCE, BATCH = 120, 1e-7, 4
#: Cells that the driver rakes (some 10 MB); more are raked by Spark, by the same steps.
MOST = 100_000


def tokens(text: Column) -> Column:
    """Words, as an estimate of tokens; a null or blank text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): each category's tokens to a power. 1 keeps the shares, 0 evens them."""
    return cells.groupBy(margin).agg(F.pow(F.sum("n_tokens").cast("double"), F.lit(power)).alias("target")).where("target > 0")


def weights(spark: SparkSession, margin: str, given: dict[str, float]) -> DataFrame:
    """(margin, target) from given weights."""
    return spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{margin} string, target double")


def completed(cells: DataFrame, margin: str, given: dict[str, float], power: float) -> DataFrame:
    """(margin, target) from given weights, and for categories without one, nulls' too, their tempered share: the
    weights part what is left of the total."""
    told = weights(cells.sparkSession, margin, given)
    found = tempered(cells, margin, power).withColumnRenamed("target", "own").join(F.broadcast(told), margin, "left")
    sums = found.agg(F.sum(F.when(F.col("target").isNotNull(), F.col("own"))).alias("__listed"), F.sum("target").alias("__weights"))
    return found.crossJoin(F.broadcast(sums)).select(margin, F.coalesce(F.try_divide(F.col("target") * F.col("__listed"), F.col("__weights")), F.when(F.col("target").isNull(), F.col("own"))).alias("target"))


class Margin(NamedTuple):
    """A margin's name, its categories' targets (name, target), and the margin whose goals they part, if any."""

    name: str
    target: DataFrame
    within: str | None = None


# Raking by the driver: arrays of one entry per cell.


def filled(want: np.ndarray, most: np.ndarray, group: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Shares of each group's budget in proportion to want; what would pass a category's most goes to the others."""
    full = np.zeros(len(want), bool)
    while True:
        used = np.bincount(group, most * full, len(budget))
        wants = np.bincount(group, want * ~full, len(budget))
        rate = np.divide(np.maximum(budget - used, 0), wants, out=np.zeros(len(budget)), where=wants > 0)[group]
        more = ~full & (want * rate >= most) & (want > 0)
        if not more.any():
            return np.where(full, most, want * rate)
        full |= more


def swept(p: np.ndarray, n: np.ndarray, code: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """One step of one margin: cells' categories as codes, and goals by code."""
    at = p >= 1
    full, loose = np.bincount(code, n * at, len(goal)), np.bincount(code, n * p * ~at, len(goal))
    under = full + loose <= goal
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(~under, goal / (full + loose), np.where(loose > 0, (goal - full) / loose, 1.0))
    return np.where(under[code] & at, 1.0, np.minimum(1.0, p * scale[code]))


def raked_here(cells: DataFrame, margins: list[Margin], fraction: float) -> DataFrame:
    table = cells.select(*[m.name for m in margins], "n_tokens").toArrow()
    n = table["n_tokens"].to_numpy().astype(np.float64)
    codes, goals, names = {}, {}, {}
    for m in margins:
        names[m.name], codes[m.name] = np.unique(np.array(table[m.name].to_pylist(), object).astype(str), return_inverse=True)
        told = m.target.groupBy(m.name).agg(F.max("target").alias("target")).toArrow().to_pydict()
        told = dict(zip(map(str, told[m.name]), told["target"], strict=True))
        want = np.array([told.get(x) or 0.0 for x in names[m.name].tolist()])
        most = np.bincount(codes[m.name], n, len(want))
        group, budget = np.zeros(len(want), np.int64), np.array([n.sum() * fraction])
        if m.within:
            group[codes[m.name]] = codes[m.within]
            budget = goals[m.within]
        goals[m.name] = filled(want * (most > 0), most, group, budget)
    p = np.full(len(n), float(fraction))
    for sweep in range(1, SWEEPS + 1):
        was = p if sweep % BATCH == 1 else was  # noqa: F821
        for m in margins:
            p = swept(p, n, codes[m.name], goals[m.name])
        if sweep % BATCH == 0 and (not len(p) or np.abs(p - was).max() < TOLERANCE):
            break
    for m in margins:
        table = table.append_column(f"goal_{m.name}", pa.array(goals[m.name][codes[m.name]]))
        table = table.append_column(f"got_{m.name}", pa.array(np.bincount(codes[m.name], n * p, len(goals[m.name]))[codes[m.name]]))
    return cells.sparkSession.createDataFrame(table.append_column("p", pa.array(p)))


# Raking by Spark: the same, for any number of cells.


def with_goals(cells: DataFrame, margins: list[Margin], fraction: float, scratch: Scratch) -> DataFrame:
    """cells with the tokens that each one's category of every margin shall give: goal_<margin>. cells are written."""
    budgets = {None: cells.agg((F.sum("n_tokens") * float(fraction)).alias("budget")).withColumn("part", F.lit(""))}
    found = []
    for m in margins:
        part = F.col(m.within) if m.within else F.lit("")
        own = cells.groupBy(m.name).agg(F.max(part).alias("part"), F.sum("n_tokens").cast("double").alias("most"))
        told = m.target.groupBy(m.name).agg(F.max("target").alias("want"))
        own = own.join(told, m.name, "left").join(budgets[m.within], "part").withColumn("want", F.when(F.col("most") > 0, F.coalesce("want", F.lit(0.0))).otherwise(0.0))
        own = scratch.save(own.withColumn("full", F.lit(False)).withColumn("rate", F.lit(0.0)), f"goals-{m.name}-0")
        turn = 0
        while True:
            turn += 1
            sums = own.groupBy("part").agg(F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).alias("used"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("want"))).alias("wants"))
            rate = F.coalesce(F.try_divide(F.greatest(F.col("budget") - F.col("used"), F.lit(0.0)), F.col("wants")), F.lit(0.0))
            step = own.join(sums, "part").withColumn("rate", rate).drop("used", "wants")
            fresh = ~F.col("full") & (F.col("want") * F.col("rate") >= F.col("most")) & (F.col("want") > 0)
            own = scratch.save(step.withColumn("fresh", fresh).withColumn("full", F.col("full") | F.col("fresh")), f"goals-{m.name}-{turn}")
            scratch.drop(f"goals-{m.name}-{turn - 1}")
            if own.where("fresh").limit(1).count() == 0:
                break
            own = own.drop("fresh")
        goal = own.select(m.name, F.when(F.col("full"), F.col("most")).otherwise(F.col("want") * F.col("rate")).alias(f"goal_{m.name}"))
        budgets[m.name] = goal.toDF("part", "budget")
        found.append(goal)
    for m, goal in zip(margins, found, strict=True):
        cells = cells.join(goal, m.name)
    return cells


def fitted(cells: DataFrame, margin: str) -> DataFrame:
    """One step: scales p so that each category of a margin meets its goal, if it can.

    In a category below its goal, cells at 1 stay and the others are scaled to give the rest; above it, all are.
    """
    by = Window.partitionBy(margin)
    goal, p, n = F.col(f"goal_{margin}"), F.col("p"), F.col("n_tokens")
    full = F.sum(F.when(p >= 1, n).otherwise(0)).over(by).cast("double")
    loose = F.sum(F.when(p < 1, n * p).otherwise(0.0)).over(by)
    seen = cells.withColumn("__full", full).withColumn("__loose", loose)
    full, loose = F.col("__full"), F.col("__loose")
    under = full + loose <= goal
    scale = F.when(~under, goal / (full + loose)).when(loose > 0, (goal - full) / loose).otherwise(1.0)
    return seen.withColumn("p", F.when(under & (p >= 1), 1.0).otherwise(F.least(F.lit(1.0), p * scale))).drop("__full", "__loose")


def raked_there(cells: DataFrame, margins: list[Margin], fraction: float, scratch: Scratch) -> DataFrame:
    now = scratch.save(with_goals(cells, margins, fraction, scratch).withColumn("p", F.lit(float(fraction))), "cells-0")
    for sweep in range(BATCH, SWEEPS + 1, BATCH):
        step = now.withColumn("was", F.col("p"))
        for _ in range(BATCH):
            for m in margins:
                step = fitted(step, m.name)
        now = scratch.save(step, f"cells-{sweep}")
        off = now.agg(F.max(F.abs(F.col("p") - F.col("was")))).first()[0]
        now = now.drop("was")
        scratch.drop(f"cells-{sweep - BATCH}")
        if off is None or off < TOLERANCE:
            break
    for m in margins:
        now = now.join(now.groupBy(m.name).agg(F.sum(F.col("n_tokens") * F.col("p")).alias(f"got_{m.name}")), m.name)
    return now


def raked(cells: DataFrame, margins: list[Margin], fraction: float, scratch: Scratch) -> DataFrame:
    """cells (a written row for each combination of margins, with n_tokens), with the probability p, weight (p over
    fraction), and for each margin what the cell's category shall give and gives: goal_ and got_<margin>.

    goal_ and got_ are shares of the budget, which is fraction of all tokens. A goal that no probabilities up to 1 can meet is lowered to what
    its category has, and the others of its margin take up the rest; where margins cannot all be met together, the
    last sweep is as near as it gets, and got_ tells how near. A category without a target gets 0.
    """
    out = raked_here(cells, margins, fraction) if cells.limit(MOST + 1).count() <= MOST else raked_there(cells, margins, fraction, scratch)
    budget = float(fraction) * (cells.agg(F.sum("n_tokens")).first()[0] or 0)
    shares = {f"{k}_{m.name}": F.try_divide(f"{k}_{m.name}", F.lit(budget)) for m in margins for k in ("goal", "got")}
    return out.withColumns(shares | {"weight": F.col("p") / float(fraction)})


MARGINS = ("source", "lang", "topic")


def topics_of(documents: DataFrame) -> langid.Model | None:
    """Clusters of words in each language (nulls as one), fitted on langid.SAMPLE documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), F.col("text").cast("string").alias("text"))
    return langid.fit(rows, features=langid.word_features)


def margined(documents: DataFrame, topics: langid.Model | None, whole: bool = True) -> DataFrame:
    """Rows of documents as a struct `row` (of doc_id alone unless whole), with their margins (nulls as NONE) and
    n_tokens. A topic is `lang/number of its nearest cluster`, or `lang/-` where the model knows no such language."""
    rows = nested(documents, text="text", source="source", lang="lang")
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    row = F.col("row") if whole else F.struct("row.doc_id").alias("row")
    cluster = langid.clusters(topics, told("lang"), F.col("text"))
    found = rows.select(row, told("source"), told("lang"), tokens(F.col("text")).alias("n_tokens"), cluster.alias("cluster"))
    return found.select("row", "source", "lang", "n_tokens", F.concat_ws("/", "lang", "cluster").alias("topic"))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that hangs on the id alone; null ids share one."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(documents: DataFrame, fraction: float, lang: dict[str, float] | None, source_power: float, topic_power: float, lang_power: float = 1.0, whole: bool = True) -> DataFrame:
    """margined(documents) with p, weight, goal_ and got_ of each margin, and sampled. Rows that repeat a doc_id are
    all taken or all left. Languages that `lang` gives no weight keep their tempered share; it parts the rest."""
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = scratch.save(margined(documents, topics_of(documents), whole), "rows")
    cells = scratch.save(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")), "sums", scratch.parts("rows"))
    langs = tempered(cells, "lang", lang_power) if lang is None else completed(cells, "lang", lang, lang_power)
    margins = [Margin("source", tempered(cells, "source", source_power)), Margin("lang", langs), Margin("topic", tempered(cells, "topic", topic_power), "lang")]
    found = scratch.save(raked(cells, margins, fraction, scratch).drop("n_tokens"), "raked")
    return rows.join(found, list(MARGINS)).withColumn("sampled", uniform(F.col("row.doc_id")) < F.col("p"))


FRACTION, LANG, SOURCE_POWER, TOPIC_POWER = 0.5, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, 0.5, 0.8


def query(documents: DataFrame) -> DataFrame:
    """Every document's margins, probability, weight and whether it is sampled, with the shares of the budget that its
    categories shall have (goal_) and are expected to have (got_)."""
    out = mixed(documents.select("doc_id", "text", "source", "lang"), FRACTION, LANG, SOURCE_POWER, TOPIC_POWER, whole=False)
    shares = [F.round(f"{k}_{m}", 6).alias(f"{k}_{m}") for m in MARGINS for k in ("goal", "got")]
    return out.select(F.col("row.doc_id").alias("doc_id"), *MARGINS, "n_tokens", F.round("p", 6).alias("probability"), F.round("weight", 6).alias("weight"), *shares, "sampled")
