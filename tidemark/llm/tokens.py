"""Exact, cached tokenisation of whole texts with a public vocabulary file.

The ``tokenizers`` library spends most of its time on offset tracking.  Its
normaliser and pre-tokeniser cut a text into pieces that the BPE model treats
independently, so a worker can cut plain texts itself (vectorised over UTF-8
bytes), hand each *distinct* piece to the library's own model once and look
repeated pieces up.  A piece is found by a hash and then compared byte by byte; one
whose hash belongs to another piece, and every piece over ``LONG_PIECE`` bytes, goes to
the model itself.  Plain means: ASCII and Latin letters from À to ÿ, without
apostrophes.  Every other text goes through ``Tokenizer.encode`` as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textbytes import blocks, hash_runs

# Byte-level alphabet: printable bytes stand for themselves, the others for
# consecutive code points from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHAR = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))
}

# Classes of UTF-8 bytes in plain texts.
_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = _LETTER
_CLASS[48:58] = _DIGIT
_LEAD = np.zeros(256, bool)
_LEAD[0xC3] = True
# Bytes that make a text other than plain: an apostrophe, C0 separators, other lead bytes.
_ODD = np.zeros(256, bool)
_ODD[[39, 28, 29, 30, 31, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True

CACHE_PIECES = 1_000_000
"""Distinct pieces that one worker keeps (some 60 MB); a fuller cache starts afresh."""
LONG_PIECE = 64
"""Bytes from which a piece is not kept."""


class TextEncoder:
    """Encodes Arrow text columns into flat id arrays with document lengths."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._reset()
        probe = "Its A1 cafÉ été, dont!!  WELL %%% 123 ß x y\n__a-b ÀÐÞ"
        try:
            got = self._encode_plain(np.frombuffer(probe.encode(), np.uint8), np.array([0, len(probe.encode())]))[0]
            self.plain = got.tolist() == self.tokenizer.encode(probe, add_special_tokens=False).ids
        except Exception:  # a vocabulary without byte-level pieces or with another normaliser
            self.plain = False

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.raw = np.zeros(0, np.uint8)
        self.raw_start = np.zeros(0, np.int64)
        self.raw_length = np.zeros(0, np.int64)

    def _model_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of all pieces, and how many each has."""
        ids: list[int] = []
        length = np.zeros(len(pieces), np.int64)
        tokenize = self.model.tokenize
        for k, piece in enumerate(pieces):
            chars = piece.decode() if piece.isalpha() else "".join([_BYTE_CHAR[b] for b in piece])
            got = [t.id for t in tokenize(chars)]
            length[k] = len(got)
            ids += got
        return np.asarray(ids, np.int32), length

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids, length = self._model_ids(pieces)
        raw_length = np.array([len(p) for p in pieces], np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, len(self.flat) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.raw_start = np.insert(self.raw_start, at, len(self.raw) + np.cumsum(raw_length) - raw_length)
        self.raw_length = np.insert(self.raw_length, at, raw_length)
        self.flat = np.concatenate((self.flat, ids))
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(pieces), np.uint8)))

    def _differs(self, low: np.ndarray, at: np.ndarray, size: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Which pieces (starts and sizes in ``low``) are not, byte by byte, the kept ones at these positions."""
        other = self.raw_length[kept] != size
        same = np.flatnonzero(~other)
        size = size[same]
        ends = np.cumsum(size)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        unlike = low[np.repeat(at[same], size) + within] != self.raw[np.repeat(self.raw_start[kept[same]], size) + within]
        other[same[np.searchsorted(ends, np.flatnonzero(unlike), side="right")]] = True
        return other

    def _encode_plain(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of plain texts."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        lead = np.flatnonzero(_LEAD[buf[:-1]]) + 1
        high = low[lead]
        low[lead] = np.where((high >= 0x80) & (high <= 0x9E), high + 0x20, high)
        kind = _CLASS[low]
        new = np.ones(len(low), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[offsets[:-1][offsets[:-1] < len(low)]] = True
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(low))
        keep = kind[at] != _SPACE
        at, ends = at[keep], ends[keep]
        size, h = ends - at, hash_runs(low, at, ends)
        short = np.flatnonzero(size <= LONG_PIECE)
        uniq, first, inverse = np.unique(h[short], return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, uniq)
        known = pos < len(self.keys)
        known[known] = self.keys[pos[known]] == uniq[known]
        raw = low.tobytes()
        if not known.all():
            fresh = short[first[~known]]
            self._learn(uniq[~known], [raw[at[i] : ends[i]] for i in fresh.tolist()])
            pos = np.searchsorted(self.keys, uniq)
        w = pos[inverse]
        start, n, flat = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), self.flat
        start[short], n[short] = self.start[w], self.length[w]
        single = np.ones(len(at), bool)
        single[short] = self._differs(low, at[short], size[short], w)
        if single.any():
            alone = np.flatnonzero(single)
            pieces, which = np.unique(np.array([raw[at[i] : ends[i]] for i in alone.tolist()], object), return_inverse=True)
            ids, length = self._model_ids(pieces.tolist())
            start[alone], n[alone] = (len(flat) + np.cumsum(length) - length)[which], length[which]
            flat = np.concatenate((flat, ids))
        before = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(start - before[:-1], n) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(at, offsets)])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, lengths) of consecutive blocks of rows; a null text is empty.

        A very long text comes as several one-row blocks, to be put together in order.
        """
        for row, offsets, buf in blocks(column):
            if len(self.keys) > CACHE_PIECES:
                self._reset()
            n = len(offsets) - 1
            odd = np.zeros(n, bool)
            if not self.plain:
                odd[:] = True
            elif len(buf):
                bad = _ODD[buf]
                lead = np.flatnonzero(_LEAD[buf[:-1]])
                bad[lead[(buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)]] = True
                odd[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = True
            if not odd.any():
                yield (row, *self._encode_plain(buf, offsets))
                continue
            # A cut long text is white-space separated from its next part, so parts stay independent.
            parts, lengths, k = [], np.zeros(n, np.int64), 0
            while k < n:
                if odd[k]:
                    text = buf[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
                    ids, m = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32), k + 1
                    lengths[k] = len(ids)
                else:
                    m = k + int(np.argmax(odd[k:])) if odd[k:].any() else n
                    ids, lengths[k:m] = self._encode_plain(buf[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k])
                parts.append(ids)
                k = m
            yield row, np.concatenate(parts).astype(np.int32), lengths


def whole_rows(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Puts one-row blocks of the same row together."""
    held: tuple[int, list[np.ndarray]] | None = None
    for row, ids, lengths in parts:
        if held and row != held[0]:
            one = np.concatenate(held[1])
            yield held[0], one, np.array([len(one)])
            held = None
        if len(lengths) == 1:
            if held:
                held[1].append(ids)
            else:
                held = (row, [ids])
        else:
            yield row, ids, lengths
    if held:
        one = np.concatenate(held[1])
        yield held[0], one, np.array([len(one)])


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    return TextEncoder(path)
