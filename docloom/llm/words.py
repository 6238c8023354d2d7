"""Token ids by way of a bounded table of pieces between which a tokenizer never merges.

Texts are cut into pieces at borders that every tokenizer here respects, pieces are hashed, and
the tokenizer encodes each piece once for as long as the table holds it. All but the tokenizer's
own work is done on whole chunks of bytes.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from .common import mix64, segment_hash, segment_sums, utf8_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces and ids that the table of a process holds at most; it is emptied when full (about 80 MB).
PIECES, HELD_IDS = 1_200_000, 8_000_000
CHUNK_BYTES = 1 << 18

_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 other ASCII signs, 4 the rest
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def rows_of(batch, *names: str, step: int = 128):
    """The rows of an Arrow batch as tuples, a few at a time as Python objects."""
    for start in range(0, batch.num_rows, step):
        yield from zip(*[batch.column(n).slice(start, step).to_pylist() for n in names], strict=True)


def _runs(kind: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than white space, and the borders within them.

    Returns starts and ends of the runs, whether a run is plain (ASCII without an apostrophe, which
    can lead a contraction), and marks of the bytes at which the kind changes in plain runs.
    """
    inside = kind > 0
    border = np.zeros(len(kind) + 1, bool)
    border[cuts] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | border[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | border[1:])) + 1
    return starts, ends, inside, border


def _plain(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    odd = np.concatenate(([0], np.cumsum((kind == 4) | (data == 0x27))))
    return odd[ends] == odd[starts]


def _inner_cuts(kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, single_digits: bool) -> np.ndarray:
    """Places within the given runs where the kind of sign changes (and between digits, if those stand alone)."""
    change = np.zeros(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    if single_digits:
        change[1:] |= (kind[1:] == 2) & (kind[:-1] == 2)
    depth = np.zeros(len(kind) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    within = np.cumsum(depth[:-1], dtype=np.int8) > 0
    change &= within
    change[starts] = False
    return np.flatnonzero(change)


def word_pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces for a tokenizer that drops white space, ends words and lowers case: bytes, starts, ends."""
    kind = _KIND[data]
    starts, ends, _, _ = _runs(kind, cuts)
    plain = _plain(data, kind, starts, ends)
    inner = _inner_cuts(kind, starts[plain], ends[plain], single_digits=True)
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts[plain]] += 1
    depth[ends[plain]] -= 1
    lowered = np.where(np.cumsum(depth[:-1], dtype=np.int8) > 0, _LOWER[data], data)
    return lowered, np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))


def _foreign_space(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000)."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    found |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    found |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    found |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[found]


def byte_pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces for byte-level tokenizers, which cover all bytes: a space leads the word after it.

    Of other white space before a word, its last sign stands alone and the rest together. A text
    with white space beyond ASCII is one piece, as that could join the ASCII white space beside it.
    """
    kind = _KIND[data]
    starts, ends, inside, border = _runs(kind, cuts)
    plain = _plain(data, kind, starts, ends)
    inner = _inner_cuts(kind, starts[plain], ends[plain], single_digits=False)
    blank = ~inside
    gap_starts = np.flatnonzero(blank & (np.concatenate(([True], inside[:-1])) | border[:-1]))
    gap_ends = np.flatnonzero(blank & (np.concatenate((inside[1:], [True])) | border[1:])) + 1
    before_word = np.zeros(len(gap_ends), bool)
    short = gap_ends < len(data)
    before_word[short] = inside[gap_ends[short]] & ~border[gap_ends[short]]
    last_is_space = data[gap_ends - 1] == 0x20 if len(gap_ends) else before_word
    # Borders: where runs and gaps begin, but for words led by a space one byte earlier.
    leads = before_word & last_is_space
    alone = before_word & ~last_is_space & (gap_ends - gap_starts > 1)
    marks = np.zeros(len(data) + 1, bool)
    marks[starts] = True
    marks[inner] = True
    marks[gap_ends[leads]] = False
    marks[gap_ends[leads] - 1] = True
    marks[gap_ends[alone] - 1] = True
    marks[gap_starts] = True
    marks[cuts] = True
    foreign = _foreign_space(data)
    if len(foreign):
        for text in np.unique(np.searchsorted(cuts, foreign, "right") - 1):
            marks[cuts[text] + 1 : cuts[text + 1]] = False
    edges = np.flatnonzero(marks[:-1])
    return data, edges, np.append(edges[1:], len(data)) if len(edges) else edges


class PieceTable:
    """Ids by the hash of a piece, in open addressing; 64 bits of hash and 32 of check tell pieces apart."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], pieces: int | None = None):
        self._encode, self._most = encode, pieces
        self._clear()

    def _clear(self, slots: int = 1 << 16) -> None:
        self._keys, self._checks, self._entry = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.int32)
        self._offsets, self._ids, self._count = np.zeros(slots + 1, np.int64), np.zeros(4 * slots, np.uint32), 0

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self._keys) - 1)
        found, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(todo):
            here = self._keys[slot]
            hit = (here == keys[todo]) & (self._checks[slot] == checks[todo])
            found[todo[hit]] = self._entry[slot[hit]]
            on = ~hit & (here != 0)
            todo, slot = todo[on], (slot[on] + 1) & int(mask)
        return found

    def _place(self, keys: np.ndarray, checks: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self._keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self._keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self._keys[slot[taken]], self._checks[slot[taken]], self._entry[slot[taken]] = keys[taken], checks[taken], entries[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, checks, entries, slot = keys[left], checks[left], entries[left], (slot[left] + 1) & mask

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: list[np.ndarray]) -> None:
        count, used = self._count + len(keys), int(self._offsets[self._count]) + sum(map(len, ids))
        while count > len(self._keys) // 2 or len(self._offsets) <= count:
            full = np.flatnonzero(self._keys)
            kept = self._keys[full], self._checks[full], self._entry[full]
            slots = 2 * len(self._keys)
            self._keys, self._checks, self._entry = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.int32)
            self._offsets = np.concatenate((self._offsets, np.zeros(slots + 1 - len(self._offsets), np.int64)))
            self._place(*kept)
        while len(self._ids) < used:
            self._ids = np.concatenate((self._ids, np.zeros(max(len(self._ids) // 2, used - len(self._ids)), np.uint32)))
        ends = int(self._offsets[self._count]) + np.cumsum([len(i) for i in ids])
        self._ids[int(self._offsets[self._count]) : used] = np.concatenate(ids)
        self._offsets[self._count + 1 : count + 1] = ends
        self._place(keys, checks, np.arange(self._count, count, dtype=np.int32))
        self._count = count

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys = segment_hash(segment_sums(data), starts, ends) | np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) ** 2, dtype=np.uint64)))
        shape = (total[ends] - total[starts]) * np.uint64(1 << 20) + (ends - starts).astype(np.uint64) * np.uint64(65_537) + data[starts] * np.uint64(257) + data[ends - 1]
        checks = (mix64(shape) >> np.uint64(32)).astype(np.uint32)
        if self._count > (self._most or PIECES) or self._offsets[self._count] > HELD_IDS:
            self._clear()
        found = self._find(keys, checks)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            chosen = missing[_distinct(keys[missing], checks[missing])]
            for i in range(0, len(chosen), 4_000):
                part = chosen[i : i + 4_000]
                self._add(keys[part], checks[part], self._encode([data[a:b].tobytes() for a, b in zip(starts[part], ends[part], strict=True)]))
            found[missing] = self._find(keys[missing], checks[missing])
        first, sizes = self._offsets[found], self._offsets[found + 1] - self._offsets[found]
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(first - (stops - sizes), sizes)
        return self._ids[at], sizes


def _distinct(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The first place of each pair."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order[head]


def hf_tokenizer(path: str):
    """A tokenizer of the tokenizers library as it is: an added token in a text has its own id."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _marked_texts(data: np.ndarray, cuts: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """The texts, by number, in which one of the marks stands."""
    said, found = data.tobytes(), set()
    for mark in marks:
        at = said.find(mark)
        while at >= 0:
            text = int(np.searchsorted(cuts, at, "right")) - 1
            inside = at + len(mark) <= cuts[text + 1]
            if inside:
                found.add(text)
            at = said.find(mark, int(cuts[text + 1]) if inside else at + 1)
    return np.array(sorted(found), np.int64)


_MADE: dict[tuple, TextEncoder] = {}


class TextEncoder:
    """Encodes the whole texts of Arrow columns; one for each tokenizer and process, so that tasks share its table.

    A text that holds an added token is one piece, since such a token parts what stands around it.
    """

    _marks: list[bytes] = []

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], pieces: Callable, most: int | None = None, marks: list[bytes] | None = None):
        self._table, self._pieces, self._marks = PieceTable(encode, most), pieces, marks or []

    @staticmethod
    def of_tokenizer(path: str, pieces: Callable, most: int | None = None) -> TextEncoder:
        key = ("tokenizers", path, pieces.__name__, most)
        if key not in _MADE:
            tokenizer = hf_tokenizer(path)
            added = tokenizer.get_added_tokens_decoder().values()
            if any(t.normalized for t in added):
                raise ValueError("added tokens that are looked for in normalized text cannot be told from the text's bytes")

            def encode(parts: list[bytes]) -> list[np.ndarray]:
                made = tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in parts], add_special_tokens=False)
                return [np.array(e.ids, np.uint32) for e in made]

            _MADE[key] = TextEncoder(encode, pieces, most, [t.content.encode() for t in added])
        return _MADE[key]

    def encode(self, column):
        """The ids of each text of an Arrow column, as uint32; a null text is empty."""
        data, offsets = utf8_buffer(column)
        first, rows = 0, len(offsets) - 1
        while first < rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            last = min(last, rows)
            cuts = offsets[first : last + 1] - offsets[first]
            raw = data[offsets[first] : offsets[last]]
            part, starts, ends = self._pieces(raw, cuts)
            marked = _marked_texts(raw, cuts, self._marks)
            if len(marked):
                part = part.copy()
                cut = ~np.isin(np.searchsorted(cuts, starts, "right") - 1, marked)
                starts, ends = np.sort(np.concatenate((starts[cut], cuts[marked]))), np.sort(np.concatenate((ends[cut], cuts[marked + 1])))
                for a, b in zip(cuts[marked], cuts[marked + 1], strict=True):
                    part[a:b] = raw[a:b]
            ids, sizes = self._table.encode(part, starts, ends)
            borders = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, cuts)]
            for a, b in zip(borders, borders[1:], strict=False):
                yield ids[a:b]
            first = last
