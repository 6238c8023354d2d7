"""Compound files (OLE2): reading and writing streams by path."""

from __future__ import annotations

import struct

# Fixed values of the format.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    """Streams of a compound file; chains that loop or leave the file end there."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self._data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self._size, self._mini_size = 1 << shift, 1 << mini_shift
        first_dir, self._cutoff, first_mini = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60))
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < END]
        more, (next_table,) = [], struct.unpack_from("<I", data, 68)
        while next_table < END and len(more) < len(data) // self._size:
            entries = struct.unpack(f"<{self._size // 4}I", self._sector(next_table))
            more += [s for s in entries[:-1] if s < END]
            next_table = entries[-1]
        self._fat = [n for s in sectors + more for n in struct.unpack(f"<{self._size // 4}I", self._sector(s))]
        self._mini_fat = [n for (n,) in struct.iter_unpack("<I", self._chain(first_mini))]
        entries = self._chain(first_dir)
        self._entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        self.streams: dict[str, tuple[int, int]] = {}
        root = self._entries[0]
        self.sector_size, self.root_size = self._size, struct.unpack_from("<Q", root, 120)[0]
        self._mini = self._chain(struct.unpack_from("<I", root, 116)[0])
        todo, seen = [(struct.unpack_from("<I", root, 76)[0], "")], set()
        while todo:
            number, prefix = todo.pop()
            if number >= len(self._entries) or number in seen:
                continue
            seen.add(number)
            e = self._entries[number]
            (length,) = struct.unpack_from("<H", e, 64)
            name = prefix + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            todo += [(left, prefix), (right, prefix)]
            if e[66] == 2:
                self.streams[name] = (struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0])
            else:
                todo.append((child, name + "/"))

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self._size
        return self._data[at : at + self._size].ljust(self._size, b"\0")

    def _chain(self, number: int) -> bytes:
        out, seen = [], set()
        while number < len(self._fat) and number not in seen:
            seen.add(number)
            out.append(self._sector(number))
            number = self._fat[number]
        return b"".join(out)

    def read(self, name: str) -> bytes:
        start, size = self.streams[name]
        if size >= self._cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < len(self._mini_fat) and start not in seen:
            seen.add(start)
            out.append(self._mini[start * self._mini_size : (start + 1) * self._mini_size])
            start = self._mini_fat[start]
        return b"".join(out)[:size]


_SECTOR, _MINI, _CUTOFF, _FAT_SECTOR, _DIFAT_SECTOR, _NONE = 512, 64, 4096, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF


class _Sectors:
    """Sectors laid out one after the other, and the chains through them."""

    def __init__(self) -> None:
        self.data: list[bytes] = []
        self.next: list[int] = []

    def add(self, content: bytes) -> int:
        if not content:
            return END
        first = len(self.data)
        self.data += [content[i : i + _SECTOR].ljust(_SECTOR, b"\0") for i in range(0, len(content), _SECTOR)]
        self.next += [*range(first + 1, len(self.data)), END]
        return first


def _entry(name: str, kind: int, start: int, size: int, links: tuple[int, int, int]) -> bytes:
    said = name.encode("utf-16-le")
    return said.ljust(64, b"\0") + struct.pack("<HBBIII", len(said) + 2 if name else 0, kind, 1, *links) + bytes(36) + struct.pack("<IQ", start, size)


def write_compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of the given streams; parts of a path are storages."""
    sectors, mini, mini_next = _Sectors(), bytearray(), []
    entries: list[dict] = [{"name": "Root Entry", "kind": 5, "children": [], "start": END, "size": 0}]
    places = {"": 0}
    for path, content in sorted(streams.items()):
        parent = ""
        for part in path.split("/")[:-1]:
            here = f"{parent}/{part}" if parent else part
            if here not in places:
                places[here] = len(entries)
                entries[places[parent]]["children"].append(len(entries))
                entries.append({"name": part, "kind": 1, "children": [], "start": 0, "size": 0})
            parent = here
        if len(content) >= _CUTOFF:
            start = sectors.add(content)
        elif content:
            start, count = len(mini_next), -(-len(content) // _MINI)
            mini += content.ljust(count * _MINI, b"\0")
            mini_next += [*range(start + 1, start + count), END]
        else:
            start = END
        entries[places[parent]]["children"].append(len(entries))
        entries.append({"name": path.split("/")[-1], "kind": 2, "children": [], "start": start, "size": len(content)})
    mini += bytes(-len(mini) % _SECTOR)
    entries[0] |= {"start": sectors.add(bytes(mini)), "size": len(mini)}
    first_mini = sectors.add(b"".join(struct.pack("<I", n) for n in mini_next))
    links = {i: [_NONE, _NONE, _NONE] for i in range(len(entries))}

    def tree(children: list[int]) -> int:
        """A balanced search tree over children in the format's order: shorter names first."""
        if not children:
            return _NONE
        middle = len(children) // 2
        links[children[middle]][:2] = tree(children[:middle]), tree(children[middle + 1 :])
        return children[middle]

    for i, e in enumerate(entries):
        links[i][2] = tree(sorted(e["children"], key=lambda c: (len(entries[c]["name"]), entries[c]["name"].upper())))
    directory = b"".join(_entry(e["name"], e["kind"], e["start"], e["size"], tuple(links[i])) for i, e in enumerate(entries))
    while len(directory) % _SECTOR:
        directory += _entry("", 0, 0, 0, (_NONE, _NONE, _NONE))
    first_dir = sectors.add(directory)

    per, used, tables, more = _SECTOR // 4, len(sectors.data), 0, 0
    while (used + tables + more) > tables * per:
        tables = -(-(used + tables + more) // per)
        more = -(-max(0, tables - 109) // (per - 1))
    chain = sectors.next + [_FAT_SECTOR] * tables + [_DIFAT_SECTOR] * more
    chain += [FREE] * (tables * per - len(chain))
    fat = [struct.pack(f"<{per}I", *chain[i : i + per]) for i in range(0, len(chain), per)]
    where = [used + i for i in range(tables)]
    difat = []
    for k in range(more):
        rest = where[109 + k * (per - 1) : 109 + (k + 1) * (per - 1)]
        rest += [FREE] * (per - 1 - len(rest))
        difat.append(struct.pack(f"<{per}I", *rest, used + tables + k + 1 if k + 1 < more else END))
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, tables, first_dir, 0, _CUTOFF, first_mini, -(-len(mini_next) * 4 // _SECTOR), used + tables if more else END, more)
    head += struct.pack("<109I", *(where[:109] + [FREE] * (109 - len(where[:109]))))
    return head + b"".join(sectors.data) + b"".join(fat) + b"".join(difat)
