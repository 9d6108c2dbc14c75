"""Word windows of texts in numbers: hashes, and anchors that equal windows have in common."""

from __future__ import annotations

import numpy as np

WINDOW = 13
#: Words of an anchor.
ANCHOR = 3
#: Windows whose keys are worked out at once.
STRETCH = 1 << 16

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def window_keys(words: list[bytes], hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window the key of its anchor: of all runs of ``ANCHOR`` words in it the one with the most bytes.

    Long runs are rare, so few anchors are shared by chance. The key depends on the window's words alone (ties are
    settled by hash), so windows of the same words have the same key wherever they stand.
    Neighbours mostly share theirs. Stretch by stretch, as the numbers on the way take several times the room of the keys.
    """
    keys = np.zeros(max(0, len(words) - window + 1), np.uint64)
    for a in range(0, len(keys), STRETCH):
        b = a + STRETCH + window - 1
        keys[a : a + STRETCH] = stretch_keys(words[a:b], hashes[a:b], window)
    return keys


def stretch_keys(words: list[bytes], hashes: np.ndarray, window: int) -> np.ndarray:
    n = len(words)
    runs = n - ANCHOR + 1
    size = np.fromiter(map(len, words), np.int64, n)
    length = sum(size[k : k + runs] for k in range(ANCHOR))
    mixed = np.zeros(runs, np.uint64)
    for k in range(ANCHOR):
        mixed = scrambled(mixed * MIX[0] + hashes[k : k + runs])
    short = (255 - np.minimum(length, 255)).astype(np.uint64)
    keys = short << np.uint64(56) | mixed >> np.uint64(8)
    # Least key of the runs of each window, by doubling.
    span, wide = 1, window - ANCHOR + 1
    while 2 * span <= wide:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if span < wide:
        keys = np.minimum(keys[: len(keys) - (wide - span)], keys[wide - span :])
    return keys


def window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window that begins at ``starts``, as two numbers."""
    first, second = np.zeros(len(starts), np.uint64), np.ones(len(starts), np.uint64)
    for k in range(window):
        word = hashes[starts + k]
        first = scrambled(first * MIX[0] + word)
        second = scrambled((second ^ word) * MIX[0] + np.uint64(k))
    return first, second


class Words:
    """Words of several texts as one sequence, so that numbers are worked out for all at once."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.parts = [text.split() for text in texts]
        self.words = [w for part in self.parts for w in part]
        sizes = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.hashes = word_hashes(self.words)
        self.keys = window_keys(self.words, self.hashes, window)
        # Text of each window; those that go on into the next text are no windows.
        self.text = np.repeat(np.arange(len(sizes)), sizes)[: len(self.keys)]
        self.whole = np.arange(len(self.keys)) + window <= self.ends[self.text]


def ranges(marked: np.ndarray) -> np.ndarray:
    """Runs of true values as start, stop, start, stop ..."""
    return np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))


def places(bounds: np.ndarray) -> np.ndarray:
    """All numbers in the runs."""
    starts, stops = bounds[::2], bounds[1::2]
    sizes = stops - starts
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
