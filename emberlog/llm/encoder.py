"""Token ids of many texts by a tokenizer library, which sees each different chunk of text once.

A text is cut where no token can lie across: before white space that follows something else. The ids
of a text are those of its chunks in a row. Chunks met before are looked up by content: those of at
most 16 bytes in a table of fixed size that compares all their bytes (the slot comes from a hash, the
answer never does), longer ones in a bounded dictionary. Chunks of over KEPT_BYTES are not kept. Texts
in which a cut could matter (other white space, control strings) go to the library whole, so the
ids are always the library's own.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import hashing
from .common import SPACES

# Spark runs one worker per core; threads of the library beside them would only wait for work.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Slots of a worker's table (23 bytes each), and ids in its pool per slot (4 bytes each) before both begin anew.
SLOT_BITS, POOL_PER_SLOT, POOL_STEP = 20, 6, 1 << 18
KEPT_BYTES, KEPT_CHUNKS = 256, 50_000
_loaded: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, plain: bool = False, slot_bits: int = SLOT_BITS) -> Encoder:
    """One encoder per file and Python worker, so that the table outlives a task."""
    key = path, plain, slot_bits
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(path, plain, slot_bits)
    return _loaded[key]


def tidy() -> None:
    """At the end of a task: give memory that is not in use back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


class ChunkTable:
    """Ids of chunks of text, looked up by content; subclasses cut texts and encode new chunks."""

    def __init__(self, slot_bits: int = SLOT_BITS) -> None:
        self.bits = slot_bits
        self._clear()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where chunks begin, as a mask over the bytes; rows' starts come on top."""
        raise NotImplementedError

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mask of the rows that must be encoded whole."""
        return np.zeros(len(offsets) - 1, bool)

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def _clear(self) -> None:
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        # An empty slot has the size 0, which no chunk has.
        self.sizes = np.zeros(1 << self.bits, np.uint8)
        self.starts, self.lengths = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.uint16)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool = np.zeros(POOL_STEP, np.uint32)
        self.used = 0

    def _keep(self, ids: np.ndarray) -> int:
        """Add ids to the pool; where they start."""
        if self.used + len(ids) > len(self.pool):
            more = -(-(self.used + len(ids) - len(self.pool)) // POOL_STEP) * POOL_STEP
            self.pool = np.concatenate([self.pool, np.zeros(more, np.uint32)])
        at = self.used
        self.pool[at:at + len(ids)] = ids
        self.used += len(ids)
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 rows ``data[offsets[i]:offsets[i + 1]]``, and how many each row has."""
        ids, counts = [], []
        for _, _, part, at in hashing.pieces(data, offsets):
            a, b = self._encode_piece(part, at)
            ids.append(a)
            counts.append(b)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32),
                np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _encode_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > POOL_PER_SLOT << self.bits or len(self.long) > KEPT_CHUNKS:
            self._clear()
        rows = len(offsets) - 1
        first = self.cuts(data)
        filled = np.flatnonzero(np.diff(offsets))
        first[offsets[filled]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(offsets, start, "right") - 1
        whole = self.whole(data, offsets)
        if whole.any():
            keep = ~whole[row]
            lone = np.flatnonzero(whole)
            start, end = np.append(start[keep], offsets[lone]), np.append(end[keep], offsets[lone + 1])
            row = np.append(row[keep], lone)
            order = np.argsort(row, kind="stable")
            start, end, row = start[order], end[order], row[order]
        where, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        size = end - start
        short = (size <= 16) & ~whole[row] if whole.any() else size <= 16
        self._short(data, np.flatnonzero(short), start, size, where, count)
        self._long(data, np.flatnonzero(~short), start, end, whole[row], where, count)
        total = np.cumsum(count)
        ids = self.pool[np.repeat(where - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.bincount(row, weights=count, minlength=rows).astype(np.int64)

    def _short(self, data, of, start, size, where, count) -> None:
        """Chunks of at most 16 bytes: two lanes and the size are the chunk."""
        if not len(of):
            return
        read = hashing.lanes(data)
        begin, n = start[of], size[of]
        low, high = hashing.lane(read, begin, n), np.zeros(len(of), np.uint64)
        over = np.flatnonzero(n > 8)
        high[over] = hashing.lane(read, begin[over] + 8, n[over] - 8)
        slot = low * np.uint64(hashing.BASE)
        slot ^= (high + n.astype(np.uint64)) * np.uint64(hashing.OTHER)
        slot ^= slot >> np.uint64(29)
        slot = (slot * np.uint64(hashing.BASE) >> np.uint64(64 - self.bits)).astype(np.int64)
        where[of], count[of] = self.starts[slot], self.lengths[slot]
        miss = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high) | (self.sizes[slot] != n))
        if not len(miss):
            return
        order = miss[np.lexsort((n[miss], high[miss], low[miss]))]
        a, b, c = low[order], high[order], n[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        one = order[new]
        raw = data.tobytes()
        got, made = self.encode_chunks([raw[x:x + k].decode() for x, k in zip(begin[one].tolist(), n[one].tolist())])
        at = self._keep(got) + np.cumsum(made) - made
        back = np.cumsum(new) - 1
        where[of[order]], count[of[order]] = at[back], made[back]
        place = slot[one]
        self.low[place], self.high[place], self.sizes[place] = low[one], high[one], n[one]
        # Of several new chunks in one slot the last one written counts, in all five arrays alike.
        self.starts[place], self.lengths[place] = at, made

    def _long(self, data, of, start, end, whole, where, count) -> None:
        """Longer chunks, and texts that go to the library whole."""
        raw = data.tobytes() if len(of) else b""
        new: dict[bytes, list[int]] = {}
        for i, a, b, lone in zip(of.tolist(), start[of].tolist(), end[of].tolist(), whole[of].tolist()):
            chunk = raw[a:b]
            if lone:
                got = self.encode_whole(chunk.decode())
                where[i], count[i] = self._keep(got), len(got)
            elif (held := self.long.get(chunk)) is not None:
                where[i], count[i] = held
            else:
                new.setdefault(chunk, []).append(i)
        if new:
            got, made = self.encode_chunks([c.decode() for c in new])
            at = self._keep(got) + np.cumsum(made) - made
            for (chunk, places), a, n in zip(new.items(), at.tolist(), made.tolist()):
                where[places], count[places] = a, n
                if len(chunk) <= KEPT_BYTES:
                    self.long[chunk] = (a, n)


class Encoder(ChunkTable):
    """Ids of the tokenizers library."""

    def __init__(self, path: str, plain: bool = False, slot_bits: int = SLOT_BITS):
        """With ``plain``, the strings of control tokens inside a text are text like any other."""
        super().__init__(slot_bits)
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain
        self.mark, token = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark_text = token.content
        # Byte-level tokens have one letter for each byte, and some a mark for the end of a word.
        ends = self.tokenizer.model.end_of_word_suffix or ""
        self.drops_space = bool(ends)
        self.token_size = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for text, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.token_size[number] = len(text.removesuffix(ends) if ends else text)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        space = hashing.is_space(data)
        first = space.copy()
        first[1:] &= ~space[:-1]
        return first

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks. Most are encoded as one text, which the lengths of its tokens part again."""
        counts, parts, of = np.zeros(len(texts), np.int64), [], []
        for places, call in zip(self._sorted(texts), (self._as_text, self._by_mark)):
            for i in range(0, len(places), 2000):
                some = places[i:i + 2000]
                chunks = [texts[k] for k in some]
                made = call(chunks)
                ids, counts[some] = made if made is not None else self._by_mark(chunks)
                parts.append(ids)
                of.append(np.repeat(some, counts[some]))
        order = np.argsort(np.concatenate(of), kind="stable")
        return np.concatenate(parts)[order], counts

    def _sorted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chunks that stay apart when they follow one another, and of the others.

        The first begin with white space and end with something else. A tokenizer that drops white
        space changes letters too; up to U+00FF that keeps their lengths.
        """
        apart = np.array([t[0] in SPACES and t[-1] not in SPACES and (not self.drops_space or max(t) < "Ā") for t in texts])
        return np.flatnonzero(apart), np.flatnonzero(~apart)

    def _as_text(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their counts, or nothing if a chunk does not end where a token ends."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        if self.drops_space:
            texts = [t.lstrip(SPACES) for t in texts]
        ends = np.cumsum([len(t.encode()) for t in texts])
        reached = np.cumsum(self.token_size[ids])
        cut = np.searchsorted(reached, ends)
        if not len(reached) or reached[-1] != ends[-1] or (reached[cut] != ends).any():
            return None
        return ids, np.diff(cut + 1, prepend=0)

    def _by_mark(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts, parted by a control token whose string is in no chunk."""
        text = self.mark_text.join(texts)
        part = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(part == self.mark)
        return np.delete(part, cut), np.diff(np.concatenate([[-1], cut, [len(part)]])) - 1

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that the library must see whole."""
        n = len(data)
        odd = ((data >= 0x1C) & (data <= 0x1F)) | ((data >= 0xE1) & (data <= 0xE3))
        if n > 1:
            after = data[1:]
            odd[:-1] |= (data[:-1] == 0xC2) & ((after == 0x85) | (after == 0xA0))
            odd[:-1] |= (data[:-1] == ord("<")) & (after == ord("|"))
        places = np.flatnonzero(odd)
        rows = np.zeros(len(offsets) - 1, bool)
        rows[np.searchsorted(offsets, places, "right") - 1] = True
        return rows

    def encode_whole(self, text: str) -> np.ndarray:
        self.tokenizer.encode_special_tokens = self.plain
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        self.tokenizer.encode_special_tokens = False
        return ids
