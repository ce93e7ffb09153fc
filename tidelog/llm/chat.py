"""Chat formatting by event-sourced reconstruction.

A log holds events (conversation, sequence, message, kind, role, text). Its events are dealt by message, so that even
one long conversation is folded by many tasks, sorted by sequence and folded:

- open   sets the role and starts an empty text
- delta  appends its text
- edit   replaces the text so far
- regenerate  discards the text so far; later deltas build the new one
- delete  removes the message; events after it bring it back

Events before the last edit or regeneration change nothing, so the fold needs only the tail behind it. Messages are
ordered by their first event, then by message, and rendered as

    <|turn|>role\\n text <|end|>

with every `~`, `<` and `[` of a role or text written as `~0`, `~1`, `~2`: no control string can then occur inside one,
and undoing the three in reverse order restores the text exactly. The loss mask covers assistants' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def folded(events: DataFrame) -> DataFrame:
    """One row per message that is left: conv_id, first_seq, message, role, text.

    A repeated event with equal sequence, kind, role and text counts once, as a log may deliver it twice. A null kind
    or sequence is ignored; a null text is empty; a null role of an open event is the empty role.
    """
    resets = ("edit", "regenerate", "delete")
    live = events.where(F.col("seq").isNotNull() & F.col("kind").isNotNull())
    told = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = live.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_set(told)).alias("log"),
        F.min("seq").alias("first_seq"),
        F.max(F.when(F.col("kind").isin(*resets), F.col("seq"))).alias("reset"),
        F.max_by(F.coalesce("role", F.lit("")), F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.max_by("kind", "seq").alias("last_kind"),
    )
    tail = F.filter("log", lambda e: (F.col("reset").isNull() | (e["seq"] >= F.col("reset"))) & e["kind"].isin("delta", "edit"))
    kept = log.where(F.col("last_kind") != "delete")
    return kept.select("conv_id", "first_seq", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss: spans (turn, start, length) in code points.

    start counts from the turn's own beginning, so that a span is read without scanning the turns before it.
    """
    role = escaped(F.col("role"))
    turn = F.struct("first_seq", "message", role.alias("role"), escaped(F.col("text")).alias("text"), (F.col("role") == LEARNT).alias("learnt"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit("\n"), t["text"], F.lit(END)))
    spans = F.transform("turns", lambda t, i: F.when(t["learnt"], F.struct(i.alias("turn"), (F.lit(len(TURN) + 1) + F.char_length(t["role"])).alias("start"), F.char_length(t["text"]).alias("length"))))
    return turns.select("conv_id", F.array_join(shown, "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def formatted(events: DataFrame) -> DataFrame:
    return rendered(folded(events))


def read_back(conversations: DataFrame) -> DataFrame:
    """formatted's rows with turns (role, text) parsed from the string alone, and learnt: the text under the mask."""
    body = F.expr(f"substring(formatted, {len(TURN) + 1})")
    shown = F.when(F.col("formatted") == "", F.array().cast("array<string>")).otherwise(F.split(body, r"<\|turn\|>", -1))
    parsed = conversations.withColumn("shown", shown)
    turn = lambda s: F.struct(unescaped(F.substring_index(s, "\n", 1)).alias("role"), unescaped(F.regexp_replace(s, r"(?s)^[^\n]*\n|<\|end\|>$", "")).alias("text"))
    under = F.transform("loss", lambda x: unescaped(F.substring(F.concat(F.lit(TURN), F.get("shown", x["turn"])), x["start"] + 1, x["length"])))
    return parsed.select("conv_id", "formatted", "loss", F.transform("shown", turn).alias("turns"), F.array_join(under, "").alias("learnt"))


def events_of(conversations: DataFrame) -> DataFrame:
    """The log that a server would have streamed for finished rows (conv_id, turn, role, text).

    Each row opens a message, streams a draft, regenerates it and streams its text in two deltas; the first half is
    then sent once more, by an edit that holds it, before the second half. Rows that repeat, or share a turn, are
    messages of their own, in the order of role and text.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.expr("cast(char_length(coalesce(text, '')) div 2 as int)")
    rows = conversations.select("conv_id", F.coalesce("turn", F.lit(1 << 40)).cast("long").alias("turn"), "role", text.alias("text"), half.alias("half"), F.monotonically_increasing_id().alias("id"))
    first, second = F.expr("substring(text, 1, half)"), F.expr("substring(text, half + 1)")
    none = F.lit(None).cast("string")
    steps = [("open", F.col("role"), none), ("delta", none, F.lit("draft")), ("regenerate", none, none), ("delta", none, F.lit("other draft")), ("edit", none, first), ("delta", none, second)]
    events = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text")) for k, (kind, role, said) in enumerate(steps)])
    message = F.struct("role", "text", "id").alias("message")
    return rows.select("conv_id", "turn", message, F.explode(events).alias("e")).select("conv_id", (F.col("turn") * len(steps) + F.col("e.step")).alias("seq"), "message", "e.kind", "e.role", "e.text")


ODD = "</s>[INST] ok [/INST]"


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    odd = spark.sql(f"select -7L as conv_id, stack(2, 0L, 'user', '{ODD}', 1L, 'assistant', '{ODD}') as (turn, role, text)")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(odd)
    back = read_back(formatted(events_of(rows)))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def sql() -> str:
    code = "replace(replace(replace({}, '~', '~0'), '<', '~1'), '[', '~2')"
    return f"""
with c as (select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '{ODD}'), (-7, 1, 'assistant', '{ODD}'))
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = '{LEARNT}'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{LEARNT}'), '')) as loss_sha256,
       sum({len(TURN) + len(END) + 1} + length({code.format('role')}) + length({code.format('text')}))::bigint as formatted_chars
from c group by conv_id"""
