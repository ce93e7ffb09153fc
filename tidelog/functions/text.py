"""Names, paths, identifiers and directory-entry words, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that no file may have on some systems, with or without an extension.
RESERVED = ["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]


def guid(value: Column) -> Column:
    """0x and 16 hexadecimal digits of a 64-bit pattern."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 16, "0"))


def parsed_guid(said: Column) -> Column:
    """The 64-bit pattern of 0x-prefixed hexadecimal or decimal digits; null for anything else."""
    s = F.lower(F.trim(said))
    return F.when(s.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(s, 3, 16), 16, -10).cast("long")).when(s.rlike("^[0-9]{1,20}$"), F.conv(s, 10, -10).cast("long"))


def dirent_object(raw: Column) -> Column:
    """The object id in a directory entry's word: its low 48 bits."""
    return raw.bitwiseAND(F.lit((1 << 48) - 1))


def dirent_type(raw: Column) -> Column:
    """The type in a directory entry's word: its highest 4 bits."""
    return F.shiftrightunsigned(raw, 60)


def dirent_letter(kind: Column) -> Column:
    return F.when(kind == 4, "d").when(kind == 8, "f").when(kind == 10, "l").otherwise("?")


def normalized_path(path: Column, inner: bool = False) -> Column:
    """/a/b for a path with any number of slashes; null if a component is refused.

    Outer paths may lack the leading slash, and . and .. are refused. Inner paths must start with one; . is dropped.
    """
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    if inner:
        parts = F.filter(parts, lambda x: x != ".")
    refused = F.exists(parts, lambda x: (x == "..") | (x == ".") | x.contains("\0"))
    bad = refused | ~path.startswith("/") if inner else refused
    return F.when(~bad, F.concat(F.lit("/"), F.array_join(parts, "/")))


def outer_parts(path: str) -> list[str]:
    """The components of one outer path, as normalized_path has them; a refused one is an error."""
    parts = [p for p in path.split("/") if p]
    if any(p in (".", "..") or "\0" in p for p in parts):
        raise ValueError(f"a path must not hold . or ..: {path}")
    return parts


def inner_parts(path: str) -> list[str]:
    """The components of one inner path: it starts with a slash, and . is dropped."""
    if not path.startswith("/"):
        raise ValueError(f"a path in an image starts with /: {path}")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if any(p == ".." or "\0" in p for p in parts):
        raise ValueError(f"a path must not hold ..: {path}")
    return parts


def child_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(parent, name)).otherwise(F.concat(parent, F.lit("/"), name))


def parent_path(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def safe_component(name: Column) -> Column:
    """Whether a name may be written as a file: no separators, controls, dots alone, or reserved device names."""
    stem = F.lower(F.substring_index(name, ".", 1))
    return ~(name.isin("", ".", "..") | name.rlike(r'[/\\<>:"|?*\x00-\x1f]') | name.rlike(r"[. ]$") | stem.isin(*RESERVED))


def is_safe(name: str) -> bool:
    """safe_component for one name."""
    return not (name in ("", ".", "..") or re.search(r'[/\\<>:"|?*\x00-\x1f]|[. ]$', name) or name.split(".")[0].lower() in RESERVED)


def vendor_format(dataset: Column) -> Column:
    n = F.lower(dataset)
    return F.when(n.contains("slide"), "slide_box").when(n.contains("datto"), "datto_reverse_roundtrip").otherwise("generic_zfs")


def size_text(n: Column) -> Column:
    """Bytes in the largest binary unit, with one decimal from KiB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << (10 * k), F.concat(F.format_string("%.1f", n / float(1 << (10 * k))), F.lit(f" {unit}"))).otherwise(out)
    return out
