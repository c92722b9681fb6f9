"""Byte-level BPE at column speed.

Pre-tokens are found for a whole Arrow column at once by byte classes; the tokenizers library then
encodes each distinct pre-token once, and its ids are dealt out by lookup. The string of an added
token is a pre-token of its own and parts the text on its two sides, as in the library.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import BYTE, U64, between, mix, prefix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_UNKNOWN = 255
#: Distinct pre-tokens that a worker remembers; beyond this it starts afresh.
REMEMBERED = 1 << 21
_LOADED: dict[str, "Bpe"] = {}


def load(path: str) -> "Bpe":
    """One encoder a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are one token wherever they stand, as the library has it.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.size = self.tokenizer.get_vocab_size()
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self._learn(np.arange(128))
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, U64)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)

    # ----------------------------------------------------------------- pre-tokens
    def _learn(self, points: np.ndarray) -> None:
        """The library itself says to which class a character belongs."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for x in points.tolist():
            c = chr(x)
            self.classes[x] = next((k for k, y in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(y + c)) == 1), SPACE)

    def _class_of(self, data: np.ndarray) -> np.ndarray:
        out = self.classes[:128][np.minimum(data, 127)]
        for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
            lead = np.flatnonzero((data >= low) & (data < high))
            if not len(lead):
                continue
            point = (data[lead] & (0xFF >> (size + 1))).astype(np.int64)
            for k in range(1, size):
                point = (point << 6) | (data[lead + k] & 0x3F)
            if (self.classes[point] == _UNKNOWN).any():
                here = np.unique(point)
                self._learn(here[self.classes[here] == _UNKNOWN])
            found = self.classes[point]
            for k in range(size):
                out[lead + k] = found
        return out

    def pre_tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First byte of every pre-token; the next one's start is its end."""
        n = len(data)
        begin = np.zeros(n + 1, bool)
        if not n:
            return np.zeros(0, np.int64)
        special = self.specials(data, offsets)
        if len(special):
            offsets = np.unique(np.concatenate([offsets, special.ravel()]))
        own = self._class_of(data)
        row = np.zeros(n + 1, bool)
        row[offsets] = True  # no pre-token crosses rows; also set past the end
        change = np.flatnonzero((own[1:] != own[:-1]) | row[1:n]) + 1
        begin[0], begin[change] = True, True
        # The last blank before other text starts a pre-token, and takes that text along if it is a plain one.
        after = change[(own[change - 1] == SPACE) & (own[change] != SPACE) & ~row[change]]
        last = after - 1
        while (inner := (data[last] & 0xC0) == 0x80).any():
            last = last - inner
        begin[last] = True
        begin[after[data[after - 1] == 32]] = False
        # 's 't 're 've 'm 'll 'd where a pre-token starts with the mark
        mark = np.flatnonzero(begin[:n] & (data == 39))
        padded = np.append(data, np.zeros(3, np.uint8))
        one, two = padded[mark + 1], padded[mark + 2]
        fits1, fits2 = ~row[mark + 1], ~row[mark + 1] & ~row[np.minimum(mark + 2, n)]
        single = fits1 & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = fits2 & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        for which, size in ((single, 2), (double, 3)):
            at = mark[which]
            begin[at + 1] = False
            begin[at + size] = True
        for a, b in special.tolist():
            begin[a + 1 : b] = False
        return np.flatnonzero(begin[:n])

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(start, end) of added tokens' strings inside one row, the first and of these the longest at a place."""
        raw, found = None, []
        for word in self.added:
            # a rare first pair of bytes rules most texts out
            heads = np.flatnonzero((data[:-1] == word[0]) & (data[1:] == word[1])) if len(word) > 1 and len(data) > 1 else np.zeros(0, np.int64)
            if len(heads):
                raw = data.tobytes() if raw is None else raw
                found += [(a, -len(word), a + len(word)) for a in heads.tolist() if raw.startswith(word, a)]
        out, last = [], 0
        for a, _, b in sorted(found):
            if a >= last and np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left"):
                out.append((a, b))
                last = b
        return np.array(out, np.int64).reshape(-1, 2)

    # ----------------------------------------------------------------- ids
    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.ids.dtype)

    def _add(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> None:
        """Encode new pre-tokens: joined by newlines, which no pre-token with other text holds."""
        blank = own[end - 1] == SPACE
        plain, sizes, ids = np.flatnonzero(~blank), np.zeros(len(start), np.int64), []
        new_starts = np.zeros(len(start), np.int64)
        if len(plain):
            size = end[plain] - start[plain]
            at = np.cumsum(size + 1) - size  # each one's place after its newline
            joined = np.full(int((size + 1).sum()), 10, np.uint8)
            joined[np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)] = data[np.arange(size.sum()) + np.repeat(start[plain] - (np.cumsum(size) - size), size)]
            flat = self._encode(joined.tobytes().decode())
            cut = np.flatnonzero(flat == self.newline)
            sizes[plain] = np.diff(np.append(cut, len(flat))) - 1
            ids.append(np.delete(flat, cut))
            new_starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
        done = int(sizes.sum())
        for i in np.flatnonzero(blank).tolist():
            ids.append(self._encode(data[start[i] : end[i]].tobytes().decode()))
            sizes[i], new_starts[i] = len(ids[-1]), done
            done += len(ids[-1])
        new_starts += len(self.ids)
        self.ids = np.concatenate([self.ids, *ids])
        at = np.searchsorted(self.known, hashes)
        self.known, self.lengths, self.starts = (np.insert(old, at, new) for old, new in ((self.known, hashes), (self.lengths, sizes), (self.starts, new_starts)))

    def _look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pre-token's entry among the known."""
        hashes = mix(between(prefix(BYTE[data]), start, end) + (end - start).astype(U64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        have = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == distinct[inside]
        if not have.all():
            if len(self.known) + int((~have).sum()) > REMEMBERED:
                self._forget()
                have[:] = False
            new = first[~have]
            self._add(distinct[~have], data, start[new], end[new], self._class_of(data))
            at = np.searchsorted(self.known, distinct)
        return at, which

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each row) of whole texts."""
        start = self.pre_tokens(data, offsets)
        if not len(start):
            return self.ids[:0], np.zeros(len(offsets), np.int64)
        entry, which = self._look_up(data, start, np.append(start[1:], len(data)))
        sizes, starts = self.lengths[entry][which], self.starts[entry][which]
        total = np.append(0, np.cumsum(sizes))
        flat = np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)
        return self.ids[flat], total[np.searchsorted(start, offsets)]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-token starts, tokens in each)."""
        start = self.pre_tokens(data, offsets)
        if not len(start):
            return start, np.zeros(0, np.int64)
        entry, which = self._look_up(data, start, np.append(start[1:], len(data)))
        return start, self.lengths[entry][which]


def texts_of(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())
