"""Hashed word n-grams of Arrow text columns, as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textbytes import blocks, hash_runs, mix64

# Bytes of blanks, of word characters (letters, digits, anything non-ASCII) and of symbols.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_REPEAT = np.uint64(0x51ED270B3F4C9A17)
_STEP = np.uint64(0x2545F4914F6CDD1D)


def ngram_slots(column: pa.Array, slots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, slot of every n-gram, row within the block of every n-gram, tokens of each row) by blocks.

    Tokens are runs of word characters or of symbols, case kept; n-grams are tokens and
    pairs of neighbouring tokens.  A token after itself counts as one and the same
    pair, whatever the token.  Texts over a block's size come in several blocks, cut
    between tokens; the pair over a cut comes with the later block.
    """
    tail: tuple[int, np.ndarray] | None = None  # row and last token of a block of one text, which may go on
    for row, offsets, buf in blocks(column):
        n = len(offsets) - 1
        if not len(buf):
            yield row, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
            continue
        kind = _KIND[buf]
        new = np.ones(len(buf), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[offsets[:-1][offsets[:-1] < len(buf)]] = True
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(buf))
        keep = kind[at] != 0
        at, ends = at[keep], ends[keep]
        h = hash_runs(buf, at, ends)
        bound = np.searchsorted(at, offsets)
        doc, tokens = np.repeat(np.arange(n), np.diff(bound)), np.diff(bound)
        left, right, of = h[:-1], h[1:], doc[1:]
        same = doc[1:] == doc[:-1]
        left, right, of = left[same], right[same], of[same]
        if n == 1 and len(h):
            if tail and tail[0] == row:
                left, right, of = (np.concatenate(x) for x in ((tail[1], left), (h[:1], right), (doc[:1], of)))
            tail = (row, h[-1:])
        pair = np.where(left == right, _REPEAT, mix64(left * _STEP + right))
        grams = np.concatenate((h, pair))
        yield row, (grams % np.uint64(slots)).astype(np.int64), np.concatenate((doc, of)), tokens


def bounded_counts(column: pa.Array, slots: int, most: int, unit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, slots, row within the block of each, whole-number weight of each), of whole texts.

    A text of at most ``most`` n-grams adds ``unit`` for each of them; a longer one adds
    as much as ``most`` do, evenly, so that no text outweighs others by its length.
    """
    held, size, at = np.zeros(slots, np.int64), 0, -1  # a block of one text may go on: it is weighed at its end

    def text() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero(held)
        return at, some, np.zeros(len(some), np.int64), held[some] * (unit * most // max(size, most))

    for row, slot, doc, tokens in ngram_slots(column, slots):
        if size and row != at:
            yield text()
            held, size = np.zeros(slots, np.int64), 0
        if len(tokens) == 1:
            held, size, at = held + np.bincount(slot, minlength=slots), size + len(slot), row
        else:
            grams = np.bincount(doc, minlength=len(tokens))
            yield row, slot, doc, (unit * most // np.maximum(grams, most))[doc]
    if size:
        yield text()
