"""Order of suffixes and their common prefixes by external induced sorting, for one shard in one task.

The suffixes that begin a valley of the text are sorted first. All others are induced from them: a queue with
a bucket for each first byte carries suffixes and their common prefix with the one before; a bucket is read
when the scan reaches its byte, and what it holds pushes its left neighbours. Queue, text and work arrays lie
on disk beyond `memory` bytes. Steps work on whole buckets, as arrays.

The valleys themselves are named by rank and ranked by doubling, which stands for the deeper rounds of the
recursion: only the first `cap` bytes of a suffix matter, so that a few doublings settle them.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Where nothing was pushed yet.
NOTHING = np.int32(1 << 30)
#: Above all values of a text.
PAST = np.uint64(511)


class Scratch:
    """Work arrays, and queues of (suffix, common prefix), on disk where they are large."""

    def __init__(self, memory: int):
        self.memory = memory

    def array(self, size: int, dtype: type) -> np.ndarray:
        if size * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(size, dtype)
        file = tempfile.TemporaryFile()
        file.truncate(max(1, size) * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(size,))

    def queue(self, buckets: int) -> Queue:
        return Queue(self, buckets)


class Queue:
    """First in, first out within a bucket; buckets are read in the order of the scan. Spills its largest bucket."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.limit, self.held = scratch.memory, 0
        self.parts: list[list] = [[] for _ in range(buckets)]
        self.files: dict[int, list] = {}

    def push(self, bucket: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.parts[bucket].append((suffixes, common))
        self.held += suffixes.nbytes + common.nbytes
        if self.held > self.limit:
            full = max(range(len(self.parts)), key=lambda b: sum(len(s) for s, _ in self.parts[b]))
            suffixes, common = self._joined(self.parts[full])
            self.files.setdefault(full, []).append((self._kept(suffixes), self._kept(common)))
            self.parts[full] = []
            self.held -= suffixes.nbytes + common.nbytes

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        kept = [(np.fromfile(a, np.int64), np.fromfile(b, np.int32)) for a, b in self.files.pop(bucket, [])]
        held, self.parts[bucket] = self.parts[bucket], []
        self.held -= sum(s.nbytes + c.nbytes for s, c in held)
        return self._joined(kept + held)

    @staticmethod
    def _kept(values: np.ndarray):
        file = tempfile.TemporaryFile()
        values.tofile(file)
        file.seek(0)
        return file

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts])


class RangeMinima:
    """Minima of ranges of an array, from minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over low..high, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out


def slopes(text: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one, and the length of the run of its first byte. The text ends with its smallest value."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last place of each run
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    lengths = np.diff(ends, prepend=-1)
    rising, run = scratch.array(n, bool), scratch.array(n, np.int32)
    rising[:] = np.repeat(rises, lengths)
    run[:] = np.minimum(np.repeat(ends, lengths) - np.arange(n) + 1, NOTHING)
    return rising, run


def sorted_valleys(text: np.ndarray, valleys: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Valley suffixes in order, and what each has in common with the one before, up to `cap` bytes."""
    m, n = len(valleys), len(text)
    if not m:
        return valleys, np.empty(0, np.int32)
    # names: the ranks of the stretches from a valley through the next, compared seven values at a time
    size = np.append(np.diff(valleys) + 1, n - valleys[-1])
    # a stretch ends where its last value begins to rise, so that it is larger than one that goes on there; the text's end is least
    past = np.full(m, PAST, np.uint64)
    past[-1] = 0
    rank, going, depth = np.zeros(m, np.int64), np.arange(m), 0
    while len(going) and depth < cap + 8:
        word = np.zeros(len(going), np.uint64)
        for i in range(depth, depth + 7):  # 7 values of 9 bits: a value and one, or what stands past the end of the stretch
            inside = size[going] > i
            word <<= np.uint64(9)
            word[inside] |= (text[valleys[going[inside]] + i] + 1).astype(np.uint64)
            word[~inside] |= past[going[~inside]]
        old = rank[going]
        order = np.argsort(word) if not depth else np.lexsort((word, old))
        rank[going[order]] = _ranks(old[order], word[order])
        depth += 7
        going = going[size[going] >= depth]
    # doubling over names: after k rounds ranks compare 2^k stretches, of two bytes or more each
    levels, span = [rank], 1
    while span * 2 <= cap + 2:
        after = np.zeros(m, np.int64)
        after[:-span] = rank[span:] + 1
        both = rank * (m + 1) + after
        order = np.argsort(both)
        both = both[order]
        new = np.empty(m, np.int64)
        new[order] = _ranks(np.zeros(m, np.int64), both)
        rank = new
        levels.append(rank)
        span *= 2
        if (both[1:] != both[:-1]).all():
            break
    order = np.argsort(rank, kind="stable")
    # common prefixes: skip equal stretches from the longest span down, then compare bytes
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(m - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < m) & (b < m)
        same = np.zeros(m - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        same &= common < cap
        step = 1 << k
        start = valleys[np.minimum(a, m - 1)]
        a[same], b[same] = a[same] + step, b[same] + step
        common[same] += (np.append(valleys, n)[np.minimum(a[same], m)] - start[same])
    going = np.flatnonzero(common < cap)
    first, second = valleys[order[:-1]], valleys[order[1:]]
    while len(going):
        i, j = first[going] + common[going], second[going] + common[going]
        fits = (i < n) & (j < n)
        going, i, j = going[fits], i[fits], j[fits]
        going = going[text[i] == text[j]]
        common[going] += 1
        going = going[common[going] < cap]
    return valleys[order], np.concatenate([[0], np.minimum(common, cap)]).astype(np.int32)


def _ranks(old: np.ndarray, key: np.ndarray) -> np.ndarray:
    """New ranks of entries sorted by (old rank, key): the old rank and how many of that rank stand before."""
    at = np.arange(len(old))
    group = np.append(True, old[1:] != old[:-1])
    run = group | np.append(True, key[1:] != key[:-1])
    return old + np.maximum.accumulate(np.where(run, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))


class Scan:
    """Pushes the left neighbours of what a scan in (ascending or descending) order of suffixes meets."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: Queue, buckets: int, cap: int):
        self.text, self.wanted, self.queue, self.cap = text, wanted, queue, cap
        self.since = np.full(buckets, -1, np.int32)  # least common prefix since a bucket's last push; -1: nothing was pushed

    def meets(self, suffixes: np.ndarray, common: np.ndarray, rising: bool) -> None:
        """common: with the suffix that the scan met before. Only neighbours of the wanted slope are pushed."""
        if not len(suffixes):
            return
        left = suffixes - 1
        at = np.flatnonzero((left >= 0) & (self.wanted[left] == rising))
        least = RangeMinima(common)
        every = np.int32(common.min())
        byte = self.text[left[at]]
        order = np.argsort(byte, kind="stable")
        at, byte = at[order], byte[order]
        cuts = np.append(np.flatnonzero(np.diff(byte.astype(np.int32), prepend=-1)), len(byte))
        shared = np.zeros(len(at), np.int32)
        if len(at):
            begins = np.zeros(len(at), bool)
            begins[cuts[:-1]] = True
            later = np.flatnonzero(~begins)
            shared[later] = least(at[later - 1] + 1, at[later]) + 1
            heads = cuts[:-1]
            before = self.since[byte[heads]]
            shared[heads] = np.where(before < 0, 0, np.minimum(before, least(np.zeros(len(heads), np.int64), at[heads])) + 1)
            shared = np.minimum(shared, self.cap)
        touched = self.since >= 0
        self.since[touched] = np.minimum(self.since[touched], every)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            b, last = int(byte[low]), int(at[high - 1])
            self.queue.push(b, left[at[low:high]], shared[low:high])
            self.since[b] = common[last + 1 :].min(initial=NOTHING)


def repeated_starts(text: np.ndarray, cap: int, memory: int = 256_000_000) -> np.ndarray:
    """For each place of `text` (values below 510; must end with its smallest value), whether the suffix there shares its first `cap` values with another's."""
    scratch, n = Scratch(memory), len(text)
    found = scratch.array(n, bool)
    if n < 2:
        return found
    buckets = int(text.max()) + 1
    rising, run = slopes(text, scratch)
    valleys = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    seeds, common = sorted_valleys(text, valleys, cap)
    cuts = np.searchsorted(text[seeds], np.arange(buckets + 1)) if len(seeds) else np.zeros(buckets + 1, int)

    def mark(suffixes: np.ndarray, shared: np.ndarray, before: int) -> None:
        long = np.flatnonzero(shared >= cap)
        found[suffixes[long]] = True
        found[np.where(long > 0, suffixes[long - 1], before)] = True

    # falling suffixes in ascending order; the last place stands before all others
    falling, ordered = scratch.queue(buckets), scratch.queue(buckets)
    scan = Scan(text, rising, falling, buckets, cap)
    falling.push(int(text[n - 1]), np.array([n - 1], np.int64), np.array([0], np.int32))
    scan.since[text[n - 1]] = 0
    for b in range(buckets):
        last = -1
        while True:
            suffixes, shared = falling.pop(b)
            if not len(suffixes):
                break
            mark(suffixes, shared, last)
            scan.meets(suffixes, shared, False)
            ordered.push(b, suffixes, shared)
            last = int(suffixes[-1])
        own, with_before = seeds[cuts[b] : cuts[b + 1]], common[cuts[b] : cuts[b + 1]].copy()
        if len(own):
            with_before[0] = min(run[last], run[own[0]], cap) if last >= 0 else 0
            scan.meets(own, with_before, False)

    # rising suffixes in descending order, from the falling ones
    queue = scratch.queue(buckets)
    scan = Scan(text, rising, queue, buckets, cap)
    for b in range(buckets - 1, -1, -1):
        last = -1
        while True:
            suffixes, shared = queue.pop(b)
            if not len(suffixes):
                break
            mark(suffixes, shared, last)
            scan.meets(suffixes, shared, True)
            last = int(suffixes[-1])
        suffixes, shared = ordered.pop(b)
        if len(suffixes):
            backwards = np.append(shared[1:], 0)[::-1].astype(np.int32)
            back = suffixes[::-1].copy()
            backwards[0] = min(run[last], run[back[0]], cap) if last >= 0 else 0
            if backwards[0] >= cap:
                found[[last, back[0]]] = True
            scan.meets(back, backwards, True)
    return found
