"""Word and shingle hashes of batches of texts, as numpy arrays. Runs inside Spark tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the polynomials over characters and words, and of their finish.
BASE, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PAD = np.uint64(0x5BD1E995)
#: Which characters part words, as str.split does; all of those lie below 0x3001.
BLANK = np.array([chr(i).isspace() for i in range(0x3002)])
BLANK_AFTER = re.compile(r"\s")
#: Characters that are hashed at once.
PIECE = 1_000_000
_powers = _inverses = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly; one to one."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


#: A value for each of the first characters, 0 for blanks; others are mixed as they come.
_VALUES = mixed(np.arange(1 << 16, dtype=np.uint64) + BASE)
_VALUES[: len(BLANK)][BLANK] = 0
BLANK = np.concatenate([BLANK, np.zeros(len(_VALUES) - len(BLANK), bool)])


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64; kept, for the longest piece so far."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, PIECE + PIECE // 4)
        _powers, _inverses = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b)])) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))
    return _powers, _inverses


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the blank-separated words of a text as it is, and where they start.

    A polynomial over the characters of each, in powers that run through the text and are taken back to the
    word's own start; blanks add nothing.
    """
    try:
        codes = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.itemsize > 1 and len(codes) and int(codes.max()) >= len(_VALUES):
        low = np.minimum(codes, len(_VALUES) - 1)
        solid, values = ~BLANK[low], np.where(codes < len(_VALUES), _VALUES[low], mixed(codes.astype(np.uint64) + BASE))
    else:
        solid, values = ~BLANK[codes], _VALUES[codes]
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    powers, inverses = _powers_up_to(len(codes))
    return mixed(np.add.reduceat(values * powers[: len(values)], starts) * inverses[starts]), starts


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """The texts lower-cased, long ones cut at blanks, with their numbers."""
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while len(text) - at > PIECE:
            blank = BLANK_AFTER.search(text, at + PIECE)
            if blank is None:
                break
            yield i, text[at : blank.start()]
            at = blank.start()
        yield i, text[at:] if at else text


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased, blank-separated words of all texts in a row, and the words in each text."""
    out, counts = [], np.zeros(len(texts), np.int64)
    held: list[tuple[int, str]] = []

    def flush() -> None:
        if held:
            hashes, starts = _hashes("\n".join(t for _, t in held))
            bounds = np.cumsum([len(t) + 1 for _, t in held])
            np.add.at(counts, [i for i, _ in held], np.diff(np.searchsorted(starts, bounds), prepend=0))
            out.append(hashes)
            held.clear()

    size = 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1]) + 1
        if size >= PIECE:
            flush()
            size = 0
    flush()
    return np.concatenate([np.zeros(0, np.uint64), *out]), counts


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each word, where n words are left in the array."""
    m = max(0, len(words) - n + 1)
    h = np.full(m, np.uint64(n), np.uint64)
    for i in range(n):
        h = h * BASE + words[i : i + m]
    return mixed(h)


def shingles(texts: list[str | None], size: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, and the words in each.

    A text of 1 to size-1 words has one shingle, of all its words; one without words has none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    m = max(0, len(words) - size + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    every = ngram_hashes(words, size)[owner[:m] == owner[size - 1 : size - 1 + m]]
    whole = np.maximum(counts - size + 1, 0)
    high = np.cumsum(whole)
    out = []
    for a, b, end, n in zip((high - whole).tolist(), high.tolist(), ends.tolist(), counts.tolist(), strict=True):
        if 0 < n < size:
            out.append(ngram_hashes(np.concatenate([words[end - n : end], np.full(size - n, PAD, np.uint64)]), size))
            continue
        own = np.sort(every[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if b > a else own)
    return out, counts
