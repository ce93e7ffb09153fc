"""Writes change streams, for tests and examples."""

from __future__ import annotations

from collections.abc import Iterable

from tidelog.functions import attributes, wire, zap


class StreamWriter:
    """Bytes of a change stream with running checksums; substream() may be called several times."""

    def __init__(self) -> None:
        self.out = bytearray()
        self.state = wire.ZERO

    def _sum(self, data: bytes) -> None:
        part, n = wire.fletcher4(data)
        self.state = wire.joined(self.state, part, n)

    def record(self, kind: str, body: bytes = b"", /, **fields: int | bytes) -> None:
        head = wire.header(kind, **fields)
        if kind == "BEGIN":
            self.state = wire.ZERO
            self._sum(head)
        else:
            if kind == "END":
                head = wire.header(kind, sum=wire.packed_sum(self.state))
            self._sum(head[: wire.SUM_AT])
            head = head[: wire.SUM_AT] + wire.packed_sum(self.state)
            self._sum(head[wire.SUM_AT :])
        self._sum(body)
        self.out += head + body

    def substream(self, name: str, to_guid: int, from_guid: int = 0, records: Iterable[tuple] = (), created: int = 0) -> None:
        """records: (kind, payload, fields)."""
        self.begin(name, to_guid, from_guid, created)
        for kind, payload, fields in records:
            self.record(kind, payload, **fields)
        self.record("END")

    def begin(self, name: str, to_guid: int, from_guid: int = 0, created: int = 0) -> None:
        self.record("BEGIN", magic=wire.MAGIC, version=wire.SUBSTREAM, to_guid=to_guid, from_guid=from_guid, name=name.encode(), creation_time=created)

    def compound_begin(self, name: str, payload: bytes = b"\0" * 8) -> None:
        self.record("BEGIN", payload, magic=wire.MAGIC, version=wire.COMPOUND, payload=len(payload), name=name.encode())
        self.record("END")

    def compound_end(self) -> None:
        self.out += wire.header("END")


def write(object_id: int, offset: int, data: bytes, kind: int = 19, codec: int = 0, packed: bytes | None = None) -> tuple:
    body = data if packed is None else packed
    return "WRITE", body, {"object": object_id, "object_type": kind, "offset": offset, "length": len(data), "codec": codec, "packed": len(body) if codec else 0}


def new_object(object_id: int, kind: int = 19, block: int = 131072) -> tuple:
    return "OBJECT", b"", {"object": object_id, "object_type": kind, "block_size": block, "slots": 1}


def free(object_id: int, offset: int, length: int = wire.TO_END) -> tuple:
    return "FREE", b"", {"object": object_id, "offset": offset, "length": length}


def free_objects(first: int, count: int) -> tuple:
    return "FREEOBJECTS", b"", {"object": first, "count": count}


#: Attributes and layouts that generated file systems use: 2 is the common layout, 3 has no size, 4 is for spills.
REGISTRY = attributes.Registry(
    {name: (k, 16 if name.endswith("TIME") else 8) for k, name in enumerate(attributes.NAMES.values())} | {"ZPL_DACL_ACES": (60, 0)},
    {2: [0, 1, 5, 3, 4, 6, 7, 8, 9, 10, 11, 2, 60], 3: [0, 5, 3, 4], 4: [1, 2]},
)
DIRECTORY_TYPE, FILE_TYPE = 20, 19


def file_object(object_id: int, size: int, kind: int = FILE_TYPE, spill: bool = False, fixed: bool = False, block: int = 131072) -> list[tuple]:
    """OBJECT (and SPILL) records of a file or directory whose attributes hold its size."""
    known = REGISTRY
    if fixed:
        bonus, bonus_type = bytearray(264), attributes.FIXED
        bonus[80:88] = size.to_bytes(8, "little")
    else:
        layout = 3 if spill else 2
        bonus, bonus_type = bytearray(attributes.encoded({"mode": 0o644, "size": size, "gen": object_id}, layout, known)), attributes.LAID_OUT
    body = bytes(bonus).ljust(-(-len(bonus) // 8) * 8, b"\0")
    out = [("OBJECT", body, {"object": object_id, "object_type": kind, "bonus_type": bonus_type, "bonus_length": len(bonus), "block_size": block, "slots": 1})]
    if spill:
        more = attributes.encoded({"size": size, "links": 2}, 4, known).ljust(512, b"\0")
        out.append(("SPILL", more, {"object": object_id, "length": len(more), "object_type": attributes.LAID_OUT}))
    return out


def table_object(object_id: int, kind: int, data: bytes, records: list[tuple] | None = None, block: int = 16384) -> list[tuple]:
    """Records of an object that holds an attribute table, in writes of a block each."""
    head = records or [("OBJECT", b"", {"object": object_id, "object_type": kind, "block_size": block, "slots": 1})]
    return [*head, *[write(object_id, i, data[i : i + block], kind) for i in range(0, len(data), block)]]


def word(kind: int, object_id: int) -> int:
    return kind << 60 | object_id


def file_system(folders: dict[str, dict[str, tuple[int, int]]], ids: dict[str, int], files: list[tuple], large: frozenset[str] = frozenset()) -> list[tuple]:
    """Records of a file system. folders: path -> name -> (entry kind, object); ids: path -> object of each folder;
    files: records of all files; large: folders whose table is a large one."""
    layouts = {str(k): (2, v) for k, v in REGISTRY.layouts.items()}
    out = table_object(1, 21, zap.micro({"ROOT": ids["/"], "SA_ATTRS": 2}))
    out += table_object(2, 45, zap.micro({"REGISTRY": 3, "LAYOUTS": 4}))
    out += table_object(3, 46, zap.micro({n: i | s << 24 for n, (i, s) in REGISTRY.attributes.items()}))
    out += table_object(4, 47, zap.large(layouts))
    for path, entries in folders.items():
        words = {n: word(*e) for n, e in entries.items()}
        data = zap.large({n: (8, [w]) for n, w in words.items()}, 4096) if path in large else zap.micro(words)
        out += table_object(ids[path], DIRECTORY_TYPE, data, file_object(ids[path], len(entries), DIRECTORY_TYPE, block=4096), 4096)
    return out + files
