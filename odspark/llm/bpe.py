"""Byte-pair encoding of whole texts through the tokenizers library, with a memo.

A text is cut where no token of the given tokenizer can reach across. The
pieces of some megabytes of texts are told apart by their bytes, so only
distinct pieces are looked at one by one; each goes through the library once
per worker and its ids are kept in a bounded memo. The texts' ids are then
gathered from those of the distinct pieces. The result equals encoding each
whole text in one call.

Plain pieces (letters) are sent many to a call, with the digit 0 between them:
digits and letters never share a token, so the 0's id marks the borders.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa

from odspark.llm import rolling as R

MEMO_ENTRIES = 300_000
_LONGEST = 64
_BATCH = 2 << 20
_PER_CALL = 256

# ids are kept as C unsigned ints: four bytes, little-endian
assert array("I").itemsize == 4 and sys.byteorder == "little"

# ASCII characters that some definition of white space counts
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# first two bytes of other white space, and the bytes before its last one
_WIDE_SECOND = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
_BEFORE_LAST = np.isin(np.arange(256), (0xC2, 0x9A, 0x80, 0x81))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.isin(np.arange(256), list(b".,;:!?"))


def _marks_behind_letters(data: np.ndarray) -> np.ndarray:
    """Positions of punctuation marks behind an ASCII or Latin-1 letter: every
    pre-tokenizer here ends a run of letters before them."""
    at = np.flatnonzero(_MARK[data])
    at = at[at > 1]
    before, before2 = data[at - 1], data[at - 2]
    latin = (before2 == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    return at[_LETTER[before] | latin]


def _cut_at_single_spaces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of pieces: of each text; every space and line break between two
    characters none of which may be white space, and what follows the break."""
    at = np.flatnonzero((data == 32) | (data == 10))
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    full = off[:-1] < off[1:]
    first[off[:-1][full]] = True
    last[off[1:][full] - 1] = True
    at = at[~(first[at] | last[at])]
    padded = np.concatenate((np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)))
    before2, before, after, after2 = (padded[at + k] for k in (0, 1, 3, 4))
    odd = _SPACE[before] | _SPACE[after] | ((before >= 0x80) & _BEFORE_LAST[before2])
    for head, seconds in _WIDE_SECOND.items():
        odd |= (after == head) & np.isin(after2, seconds)
    at = at[~odd]
    return np.concatenate((off[:-1][full], at, at[data[at] == 10] + 1))


def _plain(pieces: list[bytes]) -> np.ndarray:
    """Which pieces are ASCII or Latin-1 letters (composed forms, none of them a
    number), with a space in front or none."""
    end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if not len(data):
        return np.zeros(len(pieces), bool)
    ok = _LETTER[data]
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) + 1
    ok[second] = ok[second - 1] = True
    bad = np.concatenate(([0], np.cumsum(~ok)))
    first = np.concatenate(([0], end[:-1]))
    first = first + (data[np.minimum(first, len(data) - 1)] == 32)
    return (first < end) & (bad[end] == bad[np.minimum(first, end)])


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WIDE = 16


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte spans [start, end), and which of them each span is.

    Exact: spans of up to 16 bytes are compared as two 64-bit numbers and their
    length (a hash only brings equal ones together; where two different ones meet
    under it, they are sorted by the numbers themselves), longer ones as bytes."""
    n = end - start
    padded = np.concatenate((data, np.zeros(3 * 8, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", buffer=padded, strides=(1,))
    short = np.flatnonzero(n <= _WIDE)
    size, at = n[short], start[short]
    lo = eight[at] & _HEAD[np.minimum(size, 8)]
    hi = eight[at + 8] & _HEAD[np.maximum(size - 8, 0)]
    size = size.astype(np.uint64)
    h = R.mix(lo + R.mix(hi * np.uint64(0x9E3779B97F4A7C15) + size))
    order = np.argsort(h)

    def changes(order, *values):
        new = np.zeros(len(order), bool)
        for v in values:
            v = v[order]
            new[1:] |= v[1:] != v[:-1]
        new[:1] = True
        return new

    new = changes(order, lo, hi, size)
    if (new != changes(order, h)).any():
        order = np.lexsort((size, hi, lo))
        new = changes(order, lo, hi, size)
    which = np.empty(len(n), np.int64)
    which[short[order]] = np.cumsum(new) - 1
    raw, one = data.tobytes(), short[order[new]]
    pieces = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
    wide = np.flatnonzero(n > _WIDE)
    if len(wide):
        seen: dict[bytes, int] = {}
        first = len(pieces)
        which[wide] = [seen.setdefault(raw[a:b], first + len(seen))
                       for a, b in zip(start[wide].tolist(), end[wide].tolist())]
        pieces += seen
    return pieces, which


class MemoEncoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    ``spaces`` says how the pre-tokenizer treats white space: ``dropped`` (no
    token holds any; cut at every ASCII space) or ``leading`` (a single space
    between two other characters belongs to the word behind it, a single line
    break stands alone; cut there, leave any other white space inside its
    piece). Both kinds cut before punctuation behind a letter."""

    def __init__(self, path: str, spaces: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces = spaces
        # the pieces of late, and those of the time before: what is met again moves up
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.border = self.tokenizer.encode("0", add_special_tokens=False).ids
        assert len(self.border) == 1

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each piece."""
        marks = _marks_behind_letters(data)
        if self.spaces == "dropped":
            start, end, _ = R.words(data, off)
            start, end = np.sort(np.concatenate((start, marks))), np.sort(np.concatenate((end, marks)))
        else:
            opens = np.zeros(len(data), bool)
            opens[_cut_at_single_spaces(data, off)] = True
            opens[marks] = True
            start = np.flatnonzero(opens)
            # a mark that opens a text is no letter's neighbour there: its text starts anyway
            end = np.append(start[1:], len(data))
        return start, end, np.searchsorted(off, start, "right") - 1

    def _plain_ids(self, pieces: list[bytes]) -> Iterator[bytes]:
        """ids of pieces of letters, many to a call."""
        sep = b" 0 " if self.spaces == "dropped" else b"0"
        calls = [pieces[a:a + _PER_CALL] for a in range(0, len(pieces), _PER_CALL)]
        for part, e in zip(calls, self.tokenizer.encode_batch_fast([sep.join(c).decode() for c in calls],
                                                                   add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.border[0])
            if len(cut) != len(part) - 1:
                raise RuntimeError("a border was lost between pieces")
            raw, starts = ids.tobytes(), [0, *(4 * cut + 4).tolist()]
            yield from map(raw.__getitem__, map(slice, starts, [*(4 * cut).tolist(), len(raw)]))

    def _learn(self, new: list[bytes]) -> None:
        plain = _plain(new).tolist()
        letters = list(compress(new, plain))
        self.memo.update(zip(letters, self._plain_ids(letters)))
        other = [p for p, letter in zip(new, plain) if not letter]
        if other:
            for p, e in zip(other, self.tokenizer.encode_batch([p.decode() for p in other], add_special_tokens=False)):
                self.memo[p] = array("I", e.ids).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """ids of distinct pieces, learning the new ones."""
        found = list(map(self.memo.get, pieces))
        lacking = [k for k, ids in enumerate(found) if ids is None]
        if lacking:
            new = []
            for k in lacking:
                p = pieces[k]
                ids = self.older.get(p)
                if ids is None:
                    new.append(p)
                else:
                    self.memo[p] = ids
            self._learn(new)
            for k in lacking:
                found[k] = self.memo[pieces[k]]
            for p in [p for p in new if len(p) > _LONGEST]:
                del self.memo[p]
            if len(self.memo) > MEMO_ENTRIES // 2:
                self.memo, self.older = {}, self.memo
        return found

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """ids of each text of an Arrow column, some megabytes at a time."""
        data, off = R.text_bytes(texts)
        for i, j in R.slices(off, _BATCH):
            yield from self._encode(data[off[i]:off[j]], off[i:j + 1] - off[i])

    def _encode(self, data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        start, end, doc = self._pieces(data, off)
        pieces, which = distinct_spans(data, start, end)
        ids = self._ids(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = size[which]
        stop = np.cumsum(n)
        begin = (np.cumsum(size) - size)[which]
        out = flat[np.repeat(begin - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
        total = np.zeros(len(off) - 1, np.int64)
        np.add.at(total, doc, n)
        ends = 4 * np.cumsum(total)
        for a, b in zip((ends - 4 * total).tolist(), ends.tolist()):
            yield out[a:b]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_column(pa.array([text], pa.string())))


@R.keeps_memo
@lru_cache(maxsize=2)
def encoder(path: str, spaces: str) -> MemoEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return MemoEncoder(path, spaces)
