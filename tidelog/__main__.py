"""python -m tidelog VERB ...: what can be asked of streams, pools and images, as tab-separated lines or JSON."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tidelog.functions import keys
from tidelog.plans import catalog, filesystem, nested, pools, raw, verbs
from tidelog.session import local_session
from tidelog.sources import partitions, stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    p.add_argument("--json", action="store_true", help="JSON instead of lines")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *places: str, **flags: str) -> None:
        s = sub.add_parser(name)
        for x in places:
            s.add_argument(x)
        for flag, what in flags.items():
            s.add_argument("--" + flag.replace("_", "-"), help=what)

    verb("inspect", "source")
    verb("views", "source")
    verb("snapshots", "source")
    verb("list", "source", "path", snapshot="a snapshot, or a pool's data set", volume="a volume of an image", key_file="key material", start="first byte of the image", length="bytes of it")
    verb("extract", "source", "path", "target", snapshot="a snapshot, or a pool's data set", volume="a volume of an image", key_file="key material", start="first byte of the image", length="bytes of it")
    verb("extract-tree", "source", "path", "target", snapshot="a snapshot, or a pool's data set", volume="a volume of an image", key_file="key material", start="first byte of the image", length="bytes of it")
    verb("apply", "delta", "target")
    verb("volumes", "source")
    return p


def _key(spark: SparkSession, args: argparse.Namespace) -> bytes | None:
    if not args.key_file:
        return None
    form = raw.requirement(spark, args.source, args.snapshot)
    if form is None:
        raise filesystem.KeyNeeded("a key for what is not encrypted")
    return keys.material_of(form, args.key_file)


def _session(spark: SparkSession, args: argparse.Namespace) -> nested.Session:
    count = lambda s: None if s is None else catalog.byte_count(s)
    return nested.of_file(spark, args.source, count(args.start) or 0, count(args.length))


def answer(spark: SparkSession, args: argparse.Namespace) -> tuple[list[dict], list[str]]:
    """Rows and the columns to show."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    if args.verb == "apply":
        return [{"sha256": verbs.apply(spark, args.delta, args.target)}], ["sha256"]
    if args.verb == "volumes":
        found = rows(partitions.volumes(spark, args.source))
        return [v | {"label": partitions.label(v)} for v in found], ["label", "offset", "length", "diagnostic"]
    if args.verb == "snapshots":
        return rows(stream.snapshots(stream.records(spark, args.source)).orderBy("idx")), ["idx", "name", "to_guid", "from_guid", "raw"]
    source = catalog.opened(spark, args.source)
    if args.verb == "views":
        return rows(source.views), ["label", "selector", "view_kind", "encrypted"]
    if args.verb == "inspect":
        if source.kind == "stream":
            got = verbs.inspect(spark, args.source)
            return [{"kind": k, "records": n} for k, n in got.records.items()] + [{"kind": "bytes", "records": got.stream_bytes}], ["kind", "records"]
        if source.kind == "pool":
            return [{"what": k, "value": v} for k, v in source.source.inspect().items()], ["what", "value"]
        return rows(source.views), ["label", "selector"]
    if source.kind == "stream":
        key = _key(spark, args)
        if args.verb == "list":
            return rows(filesystem.listed(filesystem.opened(spark, args.source, args.snapshot, key=key), args.path)), ["letter", "size", "name"]
        if args.verb == "extract":
            return [{"sha256": filesystem.extract(spark, args.source, args.path, args.target, args.snapshot, key=key)}], ["sha256"]
        return [filesystem.extract_tree(spark, args.source, args.path, args.target, args.snapshot, key=key)._asdict()], ["files", "directories", "bytes", "skipped"]
    if source.kind == "pool":
        if args.snapshot is None:
            raise ValueError("name a data set or one of its snapshots")
        pool, key = source.source, None
        if args.key_file:
            key = keys.material_of(pool.key_params(args.snapshot).form, args.key_file)
        if args.verb == "list":
            return rows(pools.list_directory(spark, pool, args.snapshot, args.path, key)), ["letter", "size", "name"]
        if args.verb == "extract":
            return [{"sha256": pools.extract(spark, pool, args.snapshot, args.path, args.target, key=key)}], ["sha256"]
        return [pools.extract_tree(spark, pool, args.snapshot, args.path, args.target, key=key)._asdict()], ["files", "directories", "bytes", "skipped"]
    session = _session(spark, args)
    if args.verb == "list":
        return rows(nested.list_directory(session, args.path, args.volume).orderBy("pos")), ["letter", "size", "name"]
    if args.verb == "extract":
        return [{"sha256": nested.extract(session, args.path, args.target, args.volume)}], ["sha256"]
    return [nested.extract_tree(session, args.path, args.target, args.volume)._asdict()], ["files", "directories", "bytes", "skipped"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    for name in ("source", "delta"):
        if getattr(args, name, None) and "://" not in getattr(args, name) and not getattr(args, name).startswith("file:"):
            setattr(args, name, "file:" + str(Path(getattr(args, name)).absolute()))
    spark = SparkSession.getActiveSession() or local_session()
    try:
        found, columns = answer(spark, args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(found, default=str) if args.json else catalog.tsv(found, columns))
    return 0


if __name__ == "__main__":
    sys.exit(main())


