"""Quality rules: a table of thresholds compiled into projections of built-in functions.

A rule bounds the ratio of two counts of a text. All counts come from one narrow pass over each row: nothing is
shuffled, exploded or handed to Python, so a long document costs its own task only, and n log n in its words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.rows import nested, words_of

# Frequent function words of the four languages, in lower case.
STOP_WORDS = (
    "the of and to in is it that for with on by as at or an this from was are be "
    "der die das und von zu in ist den im ein eine es auf mit nicht sie er "
    "le la les de du des et un une en que qui dans est au pour par sur pas "
    "el los las y del que se una con por para al lo su como más"
).split()


class Rule(NamedTuple):
    """least <= of / per <= most; a null bound does not bind; per is one of the counts."""

    name: str
    of: str
    per: str
    least: float | None
    most: float | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations", "n_exclamations", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 1.5, None),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_stop_words", "n_lines")
WINDOW = 5


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """df's rows as a struct `row`, with the COUNTS of its text column as longs.

    A null text counts as an empty one; every count of an empty text is 0. Windows are compared by 64-bit hashes.
    """
    stop = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})
    rows = nested(df, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("*", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    ahead = ", ".join(f"get(hashes, i + {k})" for k in range(1, WINDOW))
    rows = rows.withColumn("windows", F.expr(f"if(n_words < {WINDOW}, cast(array() as array<bigint>), transform(slice(hashes, 1, cast(n_words as int) - {WINDOW - 1}), (h, i) -> xxhash64(h, {ahead})))")).drop("hashes")
    # Most texts repeat no window; only the others are sorted.
    rows = rows.withColumn("placed", F.expr("if(size(array_distinct(windows)) = size(windows), null, sort_array(transform(windows, (h, i) -> struct(h as h, i as i))))")).drop("windows")
    rows = rows.withColumn("twice", F.expr("sort_array(transform(filter(transform(placed, (x, k) -> struct(x.i as i, coalesce(x.h = get(placed, k - 1).h, false) or coalesce(x.h = get(placed, k + 1).h, false) as again)), x -> x.again), x -> x.i))")).drop("placed")
    covered = f"aggregate(transform(twice, (x, k) -> least({WINDOW}, coalesce(get(twice, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"
    return rows.select("row", *[c for c in COUNTS if c != "n_repeat_words"], F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def broken(rule: Rule) -> Column:
    """Whether the counts break a rule; a ratio over 0 breaks none."""
    of, per = F.col(rule.of).cast("double"), F.col(rule.per)
    low = F.lit(False) if rule.least is None else of < rule.least * per
    high = F.lit(False) if rule.most is None else of > rule.most * per
    return (per > 0) & (low | high)


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """counted(df), with base_failed, the names of the broken rules in the table's order, and kept."""
    rows = counted(df, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    names = F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return rows.select("*", base.alias("base_failed"), names.alias("broken_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def passing(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that the rules keep, with df's columns.

    The task's number, which is no function of the row, keeps the filter above the projections: pushed below them, it
    would hold a copy of every count for each use of it.
    """
    return judged(df, text, rules).withColumn("task", F.spark_partition_id()).where("kept and task >= 0").select("row.*")


def query(documents: DataFrame) -> DataFrame:
    out = judged(documents.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *COUNTS, "base_failed", F.array_join("broken_rules", ",").alias("broken_rules"), "kept")


def sql() -> str:
    """DuckDB's way to the same rows, written from the definitions: windows are compared as lists of words."""
    stop = ", ".join(f"'{f}'" for f in sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())}))
    parts = []
    for r in RULES:
        tests = [f"{r.of} < {r.least!r}::double * {r.per}"] * (r.least is not None) + [f"{r.of} > {r.most!r}::double * {r.per}"] * (r.most is not None)
        parts.append(f"case when {r.per} > 0 and ({' or '.join(tests)}) then '{r.name}' end")
    return rf"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
win as (select rid, i, words[i:i + 4] as five from w, unnest(range(1, greatest(len(words) - 3, 1))) as u(i)),
twice as (select rid, i from win qualify count(*) over (partition by rid, five) > 1),
rep as (select rid, sum(least(5, nxt - i)) as n_repeat_words
        from (select rid, i, coalesce(lead(i) over (partition by rid order by i), i + 5) as nxt from twice) group by rid),
c as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
             length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_exclamations,
             len(list_filter(words, lambda x: x in ({stop})))::bigint as n_stop_words,
             len(lines)::bigint as n_lines
      from w left join rep using (rid)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
             concat_ws(',', {", ".join(parts)}) as broken_rules from c)
select *, not base_failed and broken_rules = '' as kept from v"""
