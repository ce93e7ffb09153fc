"""Queries that apply the operators to the given tables, each with SQL for DuckDB in another formulation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import codecs, text, wire
from tidelog.operators import lineage, replay
from tidelog.streaming import replay as streaming

BLOCK = 4096
Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `events` as a replay log: a change per event, an object per user, a snapshot per day."""
    return as_log(table(spark, sf_dir, "events"))


def as_log(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "OBJECT").when(F.col("event_type").isin("view", "click"), "WRITE").when(F.col("event_type") == "purchase", "FREE").otherwise("FREEOBJECTS")
    lo = F.expr(f"(event_id * 7 % 64) * {BLOCK}")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("object"), kind.alias("kind"), lo.alias("lo"), (lo + BLOCK * (1 + F.col("event_id") % 4)).alias("hi"),
        F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("to_guid"), "event_type", "value", "props",
    )


LOG = f"""log as (select event_id as seq, user_id as object,
  case event_type when 'signup' then 'OBJECT' when 'view' then 'WRITE' when 'click' then 'WRITE' when 'purchase' then 'FREE' else 'FREEOBJECTS' end as kind,
  (event_id * 7 % 64) * {BLOCK} as lo, (event_id * 7 % 64) * {BLOCK} + {BLOCK} * (1 + event_id % 4) as hi,
  (ts::date - date '1970-01-01')::bigint as to_guid, event_type, value, props from events)"""
#: Latest change of each block of each object after its last FREEOBJECTS: the grid that the sweep is checked against.
GRID = f"""{LOG},
life as (select l.* from log l left join (select object, max(seq) as dead from log where kind = 'FREEOBJECTS' group by object) f using (object) where dead is null or seq > dead),
grid as (select object, b, arg_max(kind, seq) as kind, max(seq) as seq from (select object, seq, kind, unnest(range(lo // {BLOCK}, hi // {BLOCK})) as b from life where kind in ('WRITE', 'FREE')) group by object, b)"""


def alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.live(event_log(spark, sf_dir))


@query(f"with {LOG} select kind, count(*)::bigint as records from log group by kind")
def record_kind_counts(spark, d):
    return event_log(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


@query(f"with {LOG} select max(hi)::bigint as extent, min(lo)::bigint as first, count(*)::bigint as records from log")
def stream_extent(spark, d):
    return event_log(spark, d).agg(F.max("hi").alias("extent"), F.min("lo").alias("first"), F.count(F.lit(1)).alias("records"))


@query(f"with {LOG} select seq, case kind when 'OBJECT' then 1 when 'FREEOBJECTS' then 2 when 'WRITE' then 3 when 'FREE' then 4 end as tag, kind from log")
def header_projection(spark, d):
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in wire.TAGS.items() for x in kv]), F.col("kind"))
    return event_log(spark, d).select("seq", tag.cast("int").alias("tag"), "kind")


@query(f"with {LOG} select seq, kind, lo, hi from log where object = 17")
def object_filter_pushdown(spark, d):
    return event_log(spark, d).where("object = 17").select("seq", "kind", "lo", "hi")


@query("select p_partkey, p_size from part where p_size in (20, 21, 45, 46, 47)")
def metadata_type_inlist(spark, d):
    return table(spark, d, "part").where(F.col("p_size").isin(*wire.METADATA_TYPES)).select("p_partkey", "p_size")


@query("select p_partkey, p_size in (9, 10, 18, 19, 20, 22, 23, 25, 26, 33, 34, 35, 39, 40, 44, 45, 46, 47, 49) as encrypted from part")
def encrypted_type_flag(spark, d):
    return table(spark, d, "part").select("p_partkey", wire.encrypted_type(F.col("p_size")).alias("encrypted"))


SNAPS = f"""{LOG}, days as (select distinct to_guid from log),
snaps as (select row_number() over (order by to_guid) - 1 as idx, to_guid, coalesce(lag(to_guid) over (order by to_guid), 0) as from_guid,
 'tank/data@day' || to_guid as name from days)"""


def day_snapshots(spark, d):
    days = event_log(spark, d).select("to_guid").distinct()
    w = Window.orderBy("to_guid")  # a row per day
    return days.select((F.row_number().over(w) - 1).cast("long").alias("idx"), "to_guid", F.coalesce(F.lag("to_guid").over(w), F.lit(0)).alias("from_guid"), F.concat(F.lit("tank/data@day"), "to_guid").alias("name"))


@query(f"with {SNAPS} select name, case when from_guid = 0 then 'full' else 'incremental' end as kind, printf('0x%016x', to_guid) as guid from snaps")
def snapshot_labels(spark, d):
    return day_snapshots(spark, d).select("name", wire.full_or_incremental(F.col("from_guid")).alias("kind"), text.guid(F.col("to_guid")).alias("guid"))


@query(f"with {SNAPS} select idx, to_guid, from_guid, (select max(idx) from snaps) - idx as depth from snaps")
def ancestry_chain(spark, d):
    snaps = day_snapshots(spark, d)
    return lineage.chain(snaps, snaps.agg(F.max("idx")).first()[0])


@query(f"""with recursive {SNAPS}, plan as (select to_guid, from_guid from snaps where idx = (select max(idx) from snaps) union all select s.to_guid, s.from_guid from plan p join snaps s on s.to_guid = p.from_guid)
select to_guid, count(*)::bigint as records from log where to_guid in (select to_guid from plan) group by to_guid""")
def substream_filter(spark, d):
    """Records of the substreams that restoring the last snapshot needs: its chain of bases."""
    log = event_log(spark, d)
    plan = ancestry_chain(spark, d).select("to_guid")
    return log.join(plan, "to_guid", "left_semi").groupBy("to_guid").agg(F.count(F.lit(1)).alias("records"))


@query(f"with {SNAPS} select idx as child, case when idx > 0 then idx - 1 end as base from snaps")
def nearest_preceding(spark, d):
    return lineage.nearest_bases(day_snapshots(spark, d))


@query(f"""with {SNAPS}, wanted as (select name as selector, idx, 1 as rank from snaps where idx % 3 = 0 union all select '@day' || to_guid, idx, 2 from snaps where idx % 3 = 1
 union all select printf('0x%x', to_guid), idx, 3 from snaps where idx % 3 = 2 union all select 'nothing', null, null) select selector, idx, rank from wanted""")
def selector_resolution(spark, d):
    s = day_snapshots(spark, d)
    selector = F.when(F.col("idx") % 3 == 0, F.col("name")).when(F.col("idx") % 3 == 1, F.concat(F.lit("@day"), "to_guid")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex("to_guid"))))
    return lineage.selected(s, s.select(selector.alias("selector")).union(spark.createDataFrame([("nothing",)], "selector string")))


@query(f"with {LOG} select seq, object, last_value(case when kind = 'OBJECT' then to_guid end ignore nulls) over (partition by object order by seq rows between unbounded preceding and current row) as active from log")
def active_substream_ffill(spark, d):
    log = event_log(spark, d).withColumn("active", F.when(F.col("kind") == "OBJECT", F.col("to_guid")))
    return replay.forward_filled(log, "active", ["object"], "seq").select("seq", "object", "active")


@query(f"with {LOG} select seq, object, (select count(*) from log l where l.object = g.object and l.kind = 'FREEOBJECTS' and l.seq <= g.seq)::bigint as generation from log g")
def object_generation(spark, d):
    return replay.generations(event_log(spark, d)).select("seq", "object", F.col("generation").cast("long").alias("generation"))


@query(f"with {LOG} select object, max(seq) as seq, arg_max(value, seq) as value from log where kind = 'OBJECT' group by object")
def latest_metadata(spark, d):
    return replay.latest(event_log(spark, d), "OBJECT", "value")


@query(f"with {LOG} select object, b as block, max(seq) as seq from (select object, seq, unnest(range(lo // {BLOCK}, hi // {BLOCK})) as b from log where kind = 'WRITE') group by object, b")
def last_writer_per_block(spark, d):
    return replay.last_writers(event_log(spark, d), BLOCK)


@query(f"with {GRID} select object, (count(*) * {BLOCK})::bigint as live_bytes from grid where kind = 'WRITE' group by object")
def segments_live_bytes(spark, d):
    return replay.segments(alive(spark, d), 16 * BLOCK).groupBy("object").agg(F.sum(F.col("hi") - F.col("lo")).alias("live_bytes"))


@query(f"""with {GRID}, i as (select *, b - row_number() over (partition by object, seq order by b) as island from grid where kind = 'WRITE')
select object, min(b) * {BLOCK} as lo, (max(b) + 1) * {BLOCK} as hi, seq from i group by object, seq, island""")
def segment_map(spark, d):
    return replay.segments(alive(spark, d), 16 * BLOCK).select("object", "lo", "hi", "seq")


@query(f"""with {GRID}, w as (select object, k as window_id, k * 50000 as lo, k * 50000 + 30000 as hi from (select distinct object from log), range(4) t(k)),
g as (select object, b * {BLOCK} as glo, (b + 1) * {BLOCK} as ghi, seq from grid where kind = 'WRITE')
select object, window_id, sum(least(hi, ghi) - greatest(lo, glo))::bigint as bytes, max(seq) as last_seq from w join g using (object) where glo < hi and ghi > lo group by object, window_id""")
def positioned_read(spark, d):
    log = alive(spark, d)
    objects = event_log(spark, d).select("object").distinct()
    windows = objects.select("object", F.explode(F.expr("sequence(0L, 3L)")).alias("window")).withColumn("lo", F.col("window") * 50000).withColumn("hi", F.col("lo") + 30000)
    read = replay.positioned_reads(windows, replay.segments(log, 16 * BLOCK), 16 * BLOCK)
    return read.groupBy("object", F.col("window").alias("window_id")).agg(F.sum(F.col("hi") - F.col("lo")).alias("bytes"), F.max("seq").alias("last_seq"))


@query(f"""with {LOG}, f as (select object, max(seq) as dead from (select seq, unnest(range(object, object + 3)) as object from log where kind = 'FREEOBJECTS') group by object)
select count(*)::bigint as records, sum(seq)::bigint as seqs from log l left join f using (object) where dead is null or l.seq >= dead""")
def free_objects_anti(spark, d):
    log = event_log(spark, d)
    ranges = log.where("kind = 'FREEOBJECTS'").select("seq", F.col("object").alias("first_object"), F.lit(3).alias("count"))
    return replay.expanded_frees(log, ranges).agg(F.count(F.lit(1)).alias("records"), F.sum("seq").alias("seqs"))


@query(f"""with {LOG}, c as (select object, seq, kind, lo, case when kind = 'FREE' then 1000000000 else hi end as hi from log where kind in ('WRITE', 'FREE')),
g as (select object, unnest(range(lo // {BLOCK}, least(hi, 68 * {BLOCK}) // {BLOCK})) as b, kind, seq from c)
select object, (count(*) filter (k = 'WRITE') * {BLOCK})::bigint as live_bytes from (select object, b, arg_max(kind, seq) as k from g group by object, b) group by object having count(*) filter (k = 'WRITE') > 0""")
def free_to_end(spark, d):
    log = event_log(spark, d).withColumn("hi", F.when(F.col("kind") != "FREE", F.col("hi")))
    return replay.segments(log, 16 * BLOCK).groupBy("object").agg(F.sum(F.col("hi") - F.col("lo")).alias("live_bytes"))


@query("select r_name as name, n_name as entry, row_number() over (partition by r_name order by n_name) as place, s.n as suppliers from region join nation on n_regionkey = r_regionkey left join (select s_nationkey, count(*) as n from supplier group by 1) s on s_nationkey = n_nationkey")
def directory_listing(spark, d):
    entries = table(spark, d, "region").join(table(spark, d, "nation"), F.expr("n_regionkey = r_regionkey"))
    sizes = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    place = F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")).cast("long")
    return entries.join(sizes, F.expr("s_nationkey = n_nationkey"), "left").select(F.col("r_name").alias("name"), F.col("n_name").alias("entry"), place.alias("place"), "suppliers")


TREE = """tree as (select (1000 + r_regionkey)::bigint as node, 0::bigint as parent, r_name as name from region union all select 2000 + n_nationkey, 1000 + n_regionkey, n_name from nation
 union all select 10000 + s_suppkey, 2000 + s_nationkey, s_name from supplier)"""


def tree(spark, d):
    t = lambda name, *cols: table(spark, d, name).selectExpr(*cols)
    r = t("region", "cast(1000 + r_regionkey as bigint) as node", "0L as parent", "r_name as name")
    n = t("nation", "cast(2000 + n_nationkey as bigint) as node", "cast(1000 + n_regionkey as bigint) as parent", "n_name as name")
    return r.union(n).union(t("supplier", "10000 + s_suppkey as node", "cast(2000 + s_nationkey as bigint) as parent", "s_name as name"))


@query("select 10000 + s_suppkey as node, '/' || r_name || '/' || n_name || '/' || s_name as path from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def path_walk(spark, d):
    t = tree(spark, d)
    step = lambda k: t.select(F.col("node").alias(f"n{k}"), F.col("parent").alias(f"p{k}"), F.col("name").alias(f"name{k}"))
    walked = step(1).where("p1 = 0").join(step(2), F.expr("p2 = n1")).join(step(3), F.expr("p3 = n2"))
    return walked.select(F.col("n3").alias("node"), F.concat(F.lit("/"), F.concat_ws("/", "name1", "name2", "name3")).alias("path"))


@query(f"with recursive {TREE}, walk as (select node, '/' || name as path, 1 as depth from tree where parent = 0 union all select t.node, w.path || '/' || t.name, w.depth + 1 from walk w join tree t on t.parent = w.node) select * from walk")
def hierarchy_bfs(spark, d):
    return lineage.descent(tree(spark, d), "node", "parent", "name", 0)


@query(f"with {TREE} select node, case when node % 7 = 0 then node when parent % 7 = 0 and parent > 0 then parent when node >= 10000 then (select case when p.parent % 7 = 0 then p.parent end from tree p where p.node = tree.parent) end as key_node from tree")
def key_inheritance(spark, d):
    t = tree(spark, d).withColumn("key", F.when(F.col("node") % 7 == 0, F.col("node")))
    return lineage.inherited(t, "node", "parent", "key").select("node", F.col("key").alias("key_node"))


@query("select c_name as label, 'head' as view_kind from customer union all select s_name, 'snapshot' from supplier")
def catalog_views_union(spark, d):
    heads = table(spark, d, "customer").select(F.col("c_name").alias("label"), F.lit("head").alias("view_kind"))
    return table(spark, d, "supplier").select(F.lit("snapshot").alias("view_kind"), F.col("s_name").alias("label")).unionByName(heads).select("label", "view_kind")


@query("select n_name as dataset, c_name as snapshot from nation join customer on c_nationkey = n_nationkey")
def dataset_snapshot_pairs(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "customer"), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("dataset"), F.col("c_name").alias("snapshot"))


@query("select s_name as view, case when n_nationkey is not null then 'passphrase' else 'none' end as key_format from supplier left join (select * from nation where n_nationkey % 2 = 0) on s_nationkey = n_nationkey")
def requirement_left_join(spark, d):
    need = table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey")
    return table(spark, d, "supplier").join(need, F.expr("s_nationkey = n_nationkey"), "left").select(F.col("s_name").alias("view"), F.when(F.col("n_nationkey").isNotNull(), "passphrase").otherwise("none").alias("key_format"))


@query("select w.k as wanted, case when count(n_name) = 1 then min(n_name) end as found, count(n_name)::bigint as matches from (select upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) as k from nation union all select 'NoSuch') w left join nation on lower(n_name) = lower(w.k) group by w.k")
def case_folded_lookup(spark, d):
    n = table(spark, d, "nation").select("n_name")
    wanted = n.select(F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)"))).alias("wanted")).union(spark.createDataFrame([("NoSuch",)], "wanted string"))
    both = wanted.join(n, F.lower("n_name") == F.lower("wanted"), "left").groupBy("wanted").agg(F.count("n_name").alias("matches"), F.min("n_name").alias("found"))
    return both.select("wanted", F.when(F.col("matches") == 1, F.col("found")).alias("found"), "matches")


@query("select o_custkey, count(*)::bigint as n, count(*) = 1 as exactly_one from orders group by 1")
def exactly_one_guard(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("exactly_one", F.col("n") == 1)


@query(f"with {LOG} select count(distinct to_guid)::bigint as guids, count(distinct object)::bigint as objects from log")
def distinct_guid_check(spark, d):
    return event_log(spark, d).agg(F.count_distinct("to_guid").alias("guids"), F.count_distinct("object").alias("objects"))


@query(f"with {LOG} select object, lo, count(*)::bigint as writes from log where kind = 'WRITE' group by object, lo having count(*) > 1")
def duplicate_blocks(spark, d):
    return event_log(spark, d).where("kind = 'WRITE'").groupBy("object", "lo").agg(F.count(F.lit(1)).alias("writes")).where("writes > 1")


@query("select c_custkey, coalesce(s_acctbal, c_acctbal) as balance, coalesce(s_nationkey, c_nationkey) as nation from customer left join supplier on s_suppkey = c_custkey")
def overlay_merge(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "supplier"), F.expr("s_suppkey = c_custkey"), "left")
    return both.select("c_custkey", F.coalesce("s_acctbal", "c_acctbal").alias("balance"), F.coalesce("s_nationkey", "c_nationkey").alias("nation"))


@query("select l_orderkey, l_linenumber, coalesce(sum(l_quantity::bigint) over (partition by l_orderkey order by l_linenumber nulls first, l_partkey nulls first, l_suppkey nulls first, l_quantity nulls first, l_extendedprice nulls first, l_discount nulls first, l_tax nulls first, l_returnflag nulls first, l_linestatus nulls first, l_shipdate nulls first rows between unbounded preceding and 1 preceding), 0)::bigint as byte_offset from lineitem")
def prefix_offsets(spark, d):
    """Every row; lines that share a number follow one another by their remaining columns."""
    items = table(spark, d, "lineitem")
    rest = [c for c in items.columns if c not in ("l_orderkey", "l_linenumber")]
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *rest).rowsBetween(Window.unboundedPreceding, -1)
    return items.select("l_orderkey", "l_linenumber", F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w), F.lit(0)).alias("byte_offset"))


@query("select l_orderkey, l_linenumber, l_partkey // 32 as block, l_partkey % 32 as slot, (l_partkey >> 7) as indirect, count(*)::bigint as n from lineitem group by all")
def block_arith(spark, d):
    i = table(spark, d, "lineitem")
    return i.select("l_orderkey", "l_linenumber", F.expr("l_partkey div 32").alias("block"), (F.col("l_partkey") % 32).alias("slot"), F.shiftright("l_partkey", 7).alias("indirect")).groupBy("l_orderkey", "l_linenumber", "block", "slot", "indirect").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_orderkey as object_id, (o_custkey % 16)::bigint as dirent_type, case o_custkey % 16 when 4 then 'd' when 8 then 'f' when 10 then 'l' else '?' end as letter from orders")
def dirent_decode(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", F.shiftleft(F.col("o_custkey") % 16, 60).bitwiseOR(F.col("o_orderkey")).alias("raw"))
    return raw.select("o_orderkey", text.dirent_object(F.col("raw")).alias("object_id"), text.dirent_type(F.col("raw")).alias("dirent_type"), text.dirent_letter(text.dirent_type(F.col("raw"))).alias("letter"))


@query("select o_orderkey, printf('0x%016x', o_orderkey * 1000003) as guid from orders")
def guid_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.guid(F.col("o_orderkey") * 1000003).alias("guid"))


@query("select page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> ''), '/') as path from pages")
def path_normalize(spark, d):
    raw = F.regexp_replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "^[a-z]+://[^/]*", "")
    return table(spark, d, "pages").select("page_id", text.normalized_path(raw).alias("path"))


@query("select s_suppkey, '/pool/' || s_name as child, '/pool' as parent from supplier")
def child_parent_path(spark, d):
    child = text.child_path(F.lit("/pool"), F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", child.alias("child"), text.parent_path(child).alias("parent"))


@query("select event_id, json_extract_string(props, '$.k') as k, len(json_keys(props))::bigint as n_keys from events")
def json_state(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("select doc_id, sha256(text) as digest from documents")
def sha256_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select conv_id, sha256(string_agg(text, '' order by turn)) as digest from conversations group by 1")
def ordered_concat_digest(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("sha2(listagg(text, '') within group (order by turn), 256)").alias("digest"))


@query(None)
def crc_payload(spark, d):
    return table(spark, d, "pages").select("page_id", F.crc32(F.col("html").cast("binary")).alias("crc"))


@query(None)
def fletcher4_text(spark, d):
    """The running checksum of all pages in order, as one row of four words for each."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.rpad(F.col("html").cast("binary"), F.expr("cast((octet_length(html) + 3) div 4 * 4 as int)"), F.lit(b"\0")).alias("data"))
    return wire.running_fletcher4(rows)


@query("""with recursive l0 as (select doc_id as i, sha256(text) as h from documents),
l1 as (select i // 16 as i, sha256(string_agg(h, '' order by i)) as h from l0 group by 1), l2 as (select i // 16 as i, sha256(string_agg(h, '' order by i)) as h from l1 group by 1)
select 0 as level, i, h from l0 union all select 1, i, h from l1 union all select 2, i, h from l2""")
def mac_rollup_levels(spark, d):
    level = table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.sha2("text", 256).alias("h"))
    out = level.select(F.lit(0).alias("level"), "i", "h")
    for k in (1, 2):
        level = level.groupBy(F.expr("i div 16").alias("up")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), ""), 256).alias("h")).withColumnRenamed("up", "i")
        out = out.union(level.select(F.lit(k), "i", "h"))
    return out


@query(f"with {LOG} select count(*) filter (kind = 'WRITE')::bigint as files, (1 + count(*) filter (kind = 'OBJECT'))::bigint as directories, (sum(hi - lo) filter (kind = 'WRITE'))::bigint as logical_bytes, count(*) filter (kind not in ('WRITE', 'OBJECT'))::bigint as skipped from log")
def tree_totals(spark, d):
    k = F.col("kind")
    count = lambda c: F.count(F.when(c, 1))
    return event_log(spark, d).agg(count(k == "WRITE").alias("files"), (1 + count(k == "OBJECT")).alias("directories"), F.sum(F.when(k == "WRITE", F.col("hi") - F.col("lo"))).alias("logical_bytes"), count(~k.isin("WRITE", "OBJECT")).alias("skipped"))


@query("select o_custkey, max(o_orderkey) as txg, arg_max(o_orderpriority, o_orderkey) as label from orders group by 1")
def arg_max_label(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("txg"), F.max_by("o_orderpriority", "o_orderkey").alias("label"))


@query("select o_custkey, string_agg(o_orderpriority || ':' || o_orderkey, '; ' order by o_orderkey) as diagnostics from orders where o_orderstatus = 'F' group by 1")
def diagnostics_list(spark, d):
    said = F.struct("o_orderkey", F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("what"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["what"]), "; ").alias("diagnostics"))


@query(f"""with {LOG}, grid as (select object, b, arg_max(kind, seq) as kind, max(seq) as seq from (select object, seq, kind, unnest(range(lo // {BLOCK}, hi // {BLOCK})) as b from log where kind in ('WRITE', 'FREE')) group by object, b),
i as (select *, b - row_number() over (partition by object, seq order by b) as island from grid where kind = 'WRITE')
select object, min(b) * {BLOCK} as lo, (max(b) + 1) * {BLOCK} as hi, seq from i group by object, seq, island""")
def apply_equals_extract(spark, d):
    """The map after replaying up to the middle and applying the rest to that state; the SQL replays all at once."""
    log = event_log(spark, d).where("kind in ('WRITE', 'FREE')")
    half = log.agg(F.expr("cast(percentile(seq, 0.5) as bigint)").alias("m")).first()["m"]
    state = replay.segments(log.where(F.col("seq") <= half), 16 * BLOCK)
    carried = state.select("object", "seq", F.lit("WRITE").alias("kind"), "lo", "hi")
    after = replay.segments(carried.unionByName(log.where(F.col("seq") > half).select("object", "seq", "kind", "lo", "hi")), 16 * BLOCK)
    return after.select("object", "lo", "hi", "seq")


@query(f"with {LOG}, a as (select object, max(seq) as seq from log where to_guid < 19737 group by object), b as (select object, max(seq) as seq from log where to_guid < 19740 group by object) select * from b except select * from a")
def incremental_delta(spark, d):
    upto = lambda g: event_log(spark, d).where(F.col("to_guid") < g).groupBy("object").agg(F.max("seq").alias("seq"))
    return upto(19740).exceptAll(upto(19737))


@query("select o_custkey, count(*)::bigint as entries, count(*) > 12 as over_limit from orders group by 1")
def limit_guard(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("entries")).withColumn("over_limit", F.col("entries") > 12)


@query("select page_id, sha256(html) as digest, strlen(html)::bigint as bytes from pages")
def pages_block_scan(spark, d):
    """Every page through each codec and back."""

    def round_trip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            back = []
            for i, html in enumerate(pdf["html"]):
                data = html.encode()
                name = codecs.WRITERS[i % len(codecs.WRITERS)]
                back.append(codecs.decode(name, codecs.encode(name, data), len(data)))
            yield pd.DataFrame({"page_id": pdf["page_id"], "data": back})

    back = table(spark, d, "pages").select("page_id", "html").mapInPandas(round_trip, "page_id long, data binary")
    return back.select("page_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("bytes"))


@query(f"with {GRID} select object, (select max(seq) from log l where l.object = o.object) as last_seq, coalesce((select count(*) from grid g where g.object = o.object and g.kind = 'WRITE'), 0)::bigint * {BLOCK} as live_bytes from (select distinct object from log) o")
def streaming_replay(spark, d):
    events = table(spark, d, "events")
    arriving = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern, as it may be a file or a folder
    return streaming.replayed(as_log(arriving))
