"""CRC-32 of all runs of one to three words of a batch of texts, on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa

POLYNOMIAL = 0xEDB88320
LONGEST = 255  # bytes that one look-up moves a checksum by
STEP = 48  # words up to here are summed byte by byte for all words at once
SPAN = 1 << 20  # bytes of text that are looked at together
BLANK = crc32(b" ")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Checksum steps of the 256 bytes, and ``moved[n, k]``: byte ``k`` of a checksum moved by ``n`` bytes of zero."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    moved = np.empty((LONGEST + 1, 4, 256), np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LONGEST):
        moved[n + 1] = step[moved[n] & 255] ^ (moved[n] >> 8)
    return step, moved


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered, and whether a (lowered) byte belongs to a word: 0-9, a-z and all beyond ASCII."""
    lowered = np.arange(256, dtype=np.uint8)
    lowered[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lowered, word


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums moved by ``n`` bytes: the checksum of two strings is the first's, moved by the second's length, xor the second's."""
    tables, crc, n = _tables()[1], crc.copy(), n.copy()
    while len(far := np.flatnonzero(n > LONGEST)):
        crc[far] = _moved(crc[far], np.full(len(far), LONGEST))
        n[far] -= LONGEST
    return tables[n, 0, crc & 255] ^ tables[n, 1, (crc >> 8) & 255] ^ tables[n, 2, (crc >> 16) & 255] ^ tables[n, 3, crc >> 24]


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step, size = _tables()[0], ends - starts
    order = np.argsort(-size, kind="stable")
    at, crc = starts[order], np.full(len(starts), 0xFFFFFFFF, np.uint32)
    # words with more than i bytes come first
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, STEP), minlength=STEP + 1))
    for i in range(STEP):
        if not (n := longer[i]):
            break
        now = crc[:n]
        crc[:n] = step[(now ^ data[at[:n] + i]) & 255] ^ (now >> 8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > STEP):
        out[i] = crc32(data[starts[i] : ends[i]].tobytes())
    return out


def _bounds(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words from what lies in one; ``edges``: where a new text begins."""
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[edges] |= inside[edges]
    closes[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """``bytes, where texts begin, number of the first text, words of context`` of spans of texts.

    Short texts go together. A text beyond ``SPAN`` is cut between words; a piece begins with two words of the last one.
    """
    lowered, word = _bytes()
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SPAN, side="right")) - 1)
        if last > first + 1 or ends[last] - ends[first] <= SPAN:
            yield lowered[data[ends[first] : ends[last]]], ends[first:last] - ends[first], first, 0
        else:
            text, at, held, context = data[ends[first] : ends[last]], 0, b"", 0
            while at < len(text):
                stop = at + SPAN
                while stop < len(text) and not len(between := np.flatnonzero(~word[lowered[text[stop : stop + SPAN]]])):
                    stop += SPAN
                stop = stop + int(between[0]) if stop < len(text) else len(text)
                piece = np.concatenate([np.frombuffer(held, np.uint8), lowered[text[at:stop]]])
                yield piece, np.zeros(1, np.int64), first, context
                starts, stops = _bounds(word[piece], np.empty(0, np.int64))
                held = b"".join(piece[a:b].tobytes() + b" " for a, b in zip(starts[-2:], stops[-2:], strict=True))
                context, at = len(starts[-2:]), stop
        first = last


def run_checksums(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``text, word, crc`` arrays of spans of a column of strings: for every run of one to three words its text, whether it is a single word, and its CRC-32.

    Words are runs of 0-9, letters a-z after lowering A-Z, and characters beyond ASCII; a run's words are joined by a blank.
    """
    _, word = _bytes()
    for data, begins, first, context in _pieces(column):
        starts, ends = _bounds(word[data], begins[(begins > 0) & (begins < len(data))])
        if not len(starts):
            continue
        text = np.searchsorted(begins, starts, side="right") - 1 + first
        size, one = ends - starts, _words(data, starts, ends)
        spaced = _moved(one, np.ones(len(one), np.int64)) ^ np.uint32(BLANK)
        two = _moved(spaced[:-1], size[1:]) ^ one[1:]
        three = _moved(_moved(spaced[:-2], size[1:-1] + 1) ^ spaced[1:-1], size[2:]) ^ one[2:]
        both, all_ = text[1:] == text[:-1], text[2:] == text[:-2]
        new = np.arange(len(text)) >= context  # runs that end in words of context have been told before
        texts = [text[new], text[1:][both & new[1:]], text[2:][all_ & new[2:]]]
        yield (
            np.concatenate(texts),
            np.repeat([True, False, False], [len(t) for t in texts]),
            np.concatenate([one[new], two[both & new[1:]], three[all_ & new[2:]]]),
        )
