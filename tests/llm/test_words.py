"""Word hashes against Python's own splitting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import words
from quarry.llm.substring_dedup import selected

TEXTS = ["", None, " ", "one", "One two\nTHREE  four\x1cfive　six seven", "é É ß ẞ İx Σας ΟΔΟΣ", "\U0001f600 a\ud800b", "x" * 5000 + " y", "a b" * 3000, "the same the same"]


def by_loop(texts):
    """A number for each different word, in order, and the words of each text."""
    seen, out = {}, []
    for t in texts:
        out += [seen.setdefault(w, len(seen)) for w in (t or "").lower().split()]
    return out, [len((t or "").lower().split()) for t in texts]


def check(texts):
    hashes, counts = words.word_hashes(texts)
    want, want_counts = by_loop(texts)
    _, numbers = np.unique(hashes, return_inverse=True)
    assert counts.tolist() == want_counts and len(hashes) == len(want)
    assert len(set(zip(numbers.tolist(), want, strict=True))) == len(set(want)) == len(set(numbers.tolist()))


def test_equal_words_have_equal_hashes(monkeypatch):
    check(TEXTS)
    check([])
    whole = words.word_hashes(TEXTS)
    monkeypatch.setattr(words, "PIECE", 50)
    check(TEXTS)
    assert all(np.array_equal(a, b) for a, b in zip(whole, words.word_hashes(TEXTS), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abAÉé \n\t\x1f 　\U0001f600Σ.")), max_size=30), max_size=6))
def test_any_texts(texts):
    check(texts)


def test_shingles_are_the_sets_of_windows():
    sets, counts = words.shingles(TEXTS, 3)
    flat, sizes = words.word_hashes(TEXTS)
    at = 0
    for found, n in zip(sets, sizes.tolist(), strict=True):
        own = flat[at : at + n]
        want = np.unique(words.ngram_hashes(own, 3)) if n >= 3 else None
        assert len(found) == (0 if n == 0 else 1) if want is None else np.array_equal(found, want)
        at += n


def test_selected_places():
    rng = np.random.default_rng(4)
    for n, window, top in ((26, 26, 1 << 60), (400, 26, 1 << 60), (400, 26, 5), (50, 1, 9), (300, 7, 2)):
        grams = rng.integers(0, top, n).astype(np.uint64)
        want = sorted({i + int(grams[i : i + window].argmin()) for i in range(n - window + 1)})
        assert selected(grams, window).tolist() == want
