"""Where many texts occur in many others: a small index of 64-bit windows over bytes, run inside Spark tasks.

Each cue is known by one window of its bytes, the one that fewest cues share. A text's windows at all places meet those
in a table of bits, then by binary search, and what meets is compared in full, so that no hit is missed or wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a window, widest first: a cue is looked up by the widest that it holds. Bits of the table; places looked at together.
WIDTHS, BITS, STEP = (8, 4, 2, 1), 20, 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def mask(width: np.ndarray | int) -> np.ndarray:
    return np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * np.asarray(width, np.uint64))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number. `data` has eight bytes more than places; nothing is copied."""
    return np.ndarray(len(data) - 8, "<u8", data, strides=(1,))


class Occurrences:
    """Cues, as bytes that are not empty; `found` tells which of them occur in each of many texts."""

    def __init__(self, cues: list[bytes]):
        self.sizes = np.array([len(c) for c in cues], np.int64)
        self.starts = np.cumsum(np.concatenate([[0], self.sizes]))[:-1].astype(np.int64)
        self.data = np.frombuffer(b"".join(cues) + bytes(16), np.uint8)
        words = words_at(self.data)
        self.tables = []
        kind = np.select([self.sizes >= w for w in WIDTHS], list(range(len(WIDTHS))), len(WIDTHS))
        for k, width in enumerate(WIDTHS):
            own = np.flatnonzero(kind == k)
            if not len(own):
                continue
            # all windows of these cues; of each cue, the one that fewest share
            counts = self.sizes[own] - width + 1
            cue = np.repeat(np.arange(len(own)), counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            windows = words[self.starts[own][cue] + at] & mask(width)
            _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
            order = np.lexsort((at, n[back], cue))
            best = order[np.concatenate([[0], np.cumsum(counts)[:-1]])]
            keys, which = np.unique(windows[best], return_inverse=True)
            by_key = np.argsort(which, kind="stable")
            firsts = np.searchsorted(which[by_key], np.arange(len(keys) + 1))
            bits = np.zeros(1 << BITS, bool)
            bits[self.slot(keys)] = True
            self.tables.append((width, keys, firsts, own[by_key], at[best][by_key], bits))

    @staticmethod
    def slot(windows: np.ndarray) -> np.ndarray:
        return ((windows * MIX) >> np.uint64(64 - BITS)).astype(np.int64)

    def found(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts and cues, a pair each, in order. Text i lies in `data` from `bounds[i]` to `bounds[i + 1]`."""
        data, first, last = np.concatenate([data[bounds[0] : bounds[-1]], np.zeros(16, np.uint8)]), bounds[0], bounds[-1] - bounds[0]
        words, bounds = words_at(data), bounds - first
        n_cues, pairs = len(self.sizes), [np.zeros(0, np.int64)]
        for low in range(0, int(last), STEP):
            here = words[low : min(low + STEP, int(last))].copy()
            for width, keys, firsts, cues, offsets, bits in self.tables:
                windows = here & mask(width) if width < 8 else here
                at = np.flatnonzero(bits[self.slot(windows)])
                place = np.searchsorted(keys, windows[at])
                same = keys[np.minimum(place, len(keys) - 1)] == windows[at]
                at, place = at[same], place[same]
                n = firsts[place + 1] - firsts[place]
                entry = np.repeat(firsts[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cue, start = cues[entry], np.repeat(at + low, n) - offsets[entry]
                text = np.searchsorted(bounds, start, "right") - 1
                fits = np.flatnonzero((start >= 0) & (text >= 0) & (start + self.sizes[cue] <= bounds[np.clip(text + 1, 0, len(bounds) - 1)]))
                cue, start, text = cue[fits], start[fits], text[fits]
                # word by word, those that still agree
                done = 0
                while len(cue):
                    left = np.minimum(self.sizes[cue] - done, 8)
                    agree = ((words[start + done] ^ self.words[self.starts[cue] + done]) & mask(left)) == 0
                    done += 8
                    whole = agree & (self.sizes[cue] <= done)
                    pairs.append(np.unique(text[whole] * n_cues + cue[whole]))
                    on = agree & ~whole
                    cue, start, text = cue[on], start[on], text[on]
        every = np.unique(np.concatenate(pairs))
        return every // max(n_cues, 1), every % max(n_cues, 1)

    @property
    def words(self) -> np.ndarray:
        return words_at(self.data)

    def found_in(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`found` for texts as Arrow holds them; null has no cues."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        return self.found(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds)
