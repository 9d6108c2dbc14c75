"""Linear-chain conditional random field over the lines of a text, two labels: 0 boilerplate, 1 content.

A line is described by a few yes/no features, packed in one integer. Fitting takes
sequences of such integers; decoding finds the best label sequence (Viterbi).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

FEATURES = (
    "any", "one_word", "few_words", "some_words", "many_words", "ends_sentence", "starts_lower", "shouts",
    "symbols", "symbol_heavy", "digits", "pipes", "bullet", "address", "seen_before", "one_word_rules",
    "short_words", "long_words", "first_line", "last_line", "no_letters",
)
BIT = {name: 1 << k for k, name in enumerate(FEATURES)}
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
ASCII_OTHER = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))
SYMBOLS = b"#*$%&|<>"
#: Lines of a sequence fitted at once, and cells of a batch of sequences.
PART_LINES, BATCH_CELLS = 2000, 100_000


def line_mask(line: bytes, words: list[bytes], seen: bool) -> int:
    """Features of one line with at least one word."""
    mask, n, size = BIT["any"], len(words), len(line)
    mask |= BIT["one_word"] if n == 1 else BIT["few_words"] if n < 6 else BIT["some_words"] if n < 16 else BIT["many_words"]
    if words[-1][-1:] in b".!?;:":
        mask |= BIT["ends_sentence"]
    if words[0][:1].islower():
        mask |= BIT["starts_lower"]
    letters = len(line.translate(None, ASCII_OTHER))
    if not letters:
        mask |= BIT["no_letters"]
    elif 2 * (size - len(line.translate(None, UPPER))) > letters:
        mask |= BIT["shouts"]
    symbols = size - len(line.translate(None, SYMBOLS))
    if 20 * symbols > size:
        mask |= BIT["symbols"] | (BIT["symbol_heavy"] if 5 * symbols > size else 0)
    if 5 * (size - len(line.translate(None, DIGITS))) > size:
        mask |= BIT["digits"]
    if 8 * words.count(b"|") > n:
        mask |= BIT["pipes"]
    if words[0] in (b"-", b"*", b"+", b"\xe2\x80\xa2"):
        mask |= BIT["bullet"]
    if b"://" in line or b"www." in line or b"@" in line:
        mask |= BIT["address"]
    if seen:
        mask |= BIT["seen_before"]
    if n > 3 and 3 * max(Counter(words).values()) > n:
        mask |= BIT["one_word_rules"]
    if size < 3 * n:
        mask |= BIT["short_words"]
    elif size > 13 * n:
        mask |= BIT["long_words"]
    return mask


def line_masks(lines: list[tuple[bytes, list[bytes], bool]]) -> list[int]:
    """Masks of the lines of one text; the flag tells a line equal to an earlier one."""
    masks = [line_mask(*line) for line in lines]
    if masks:
        masks[0] |= BIT["first_line"]
        masks[-1] |= BIT["last_line"]
    return masks


def expand(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


class LineField:
    """``weights``: features x 2; ``step``: score of going from one label to the next."""

    def __init__(self, weights: np.ndarray | None = None, step: np.ndarray | None = None):
        self.weights = np.zeros((len(FEATURES), 2)) if weights is None else weights
        self.step = np.zeros((2, 2)) if step is None else step
        self.scores: dict[int, tuple[float, float]] = {}

    def score(self, mask: int) -> tuple[float, float]:
        found = self.scores.get(mask)
        if found is None:
            row = expand(np.array([mask]))[0] @ self.weights
            found = self.scores[mask] = (float(row[0]), float(row[1]))
        return found

    def decode(self, masks: list[int]) -> list[int]:
        """The best labels; of equally good ones those with content."""
        if not masks:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one = self.score(masks[0])
        back: list[tuple[int, int]] = []
        for mask in masks[1:]:
            e0, e1 = self.score(mask)
            from0 = 1 if one + s10 >= zero + s00 else 0
            from1 = 1 if one + s11 >= zero + s01 else 0
            zero, one = (
                e0 + (one + s10 if from0 else zero + s00),
                e1 + (one + s11 if from1 else zero + s01),
            )
            back.append((from0, from1))
        label = 1 if one >= zero else 0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(
        cls, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, penalty: float = 1e-3,
        rate: float = 0.3,
    ) -> LineField:
        """Maximum likelihood with an L2 penalty, by adaptive gradient steps over all sequences.

        A sequence of more than ``PART_LINES`` lines is taken in parts that share a line, so that no step is lost.
        """
        parts = ((s[k : k + PART_LINES], y[k : k + PART_LINES]) for s, y in zip(sequences, labels)
                 for k in range(0, max(len(s) - 1, 1), PART_LINES - 1))
        kept = [(s, y) for s, y in parts if len(s)]
        if not kept:
            return cls()
        kept.sort(key=lambda x: len(x[0]))
        model = cls()
        kinds = np.unique(np.concatenate([s for s, _ in kept]))
        features = expand(kinds)
        batches = []
        for part in evened(kept):
            longest = len(part[-1][0])
            which = np.zeros((len(part), longest), np.int64)
            wanted = np.zeros((len(part), longest), np.int64)
            length = np.array([len(s) for s, _ in part])
            for k, (s, y) in enumerate(part):
                which[k, : len(s)] = np.searchsorted(kinds, s)
                wanted[k, : len(s)] = y
            batches.append((which, wanted, length))
        seen_w, seen_s = np.full_like(model.weights, 1e-8), np.full_like(model.step, 1e-8)
        total = sum(len(s) for s, _ in kept)
        for _ in range(rounds):
            scores = features @ model.weights
            by_kind, step = np.zeros((len(kinds), 2)), np.zeros((2, 2))
            for which, wanted, length in batches:
                a, b = expected_less_wanted(scores[which], model.step, wanted, length)
                flat = which.ravel()
                for y in (0, 1):
                    by_kind[:, y] += np.bincount(flat, a[:, :, y].ravel(), len(kinds))
                step += b
            grad_w = features.T @ by_kind / total + penalty * model.weights
            grad_s = step / total + penalty * model.step
            seen_w += grad_w**2
            seen_s += grad_s**2
            model.weights -= rate * grad_w / np.sqrt(seen_w)
            model.step -= rate * grad_s / np.sqrt(seen_s)
        return model


def evened(kept: list[tuple[np.ndarray, np.ndarray]], cells: int = BATCH_CELLS) -> Iterator[list]:
    """Sequences, sorted by length, in batches that have about ``cells`` cells when filled up to their longest."""
    part: list = []
    for entry in kept:
        if part and (len(part) + 1) * len(entry[0]) > cells:
            yield part
            part = []
        part.append(entry)
    yield part


def expected_less_wanted(
    scores: np.ndarray, step: np.ndarray, wanted: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log-likelihood by line scores and by steps (forward-backward)."""
    n, longest, _ = scores.shape
    ahead = np.empty_like(scores)
    behind = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, longest):
        ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + scores[:, t]
    for t in range(longest - 2, -1, -1):
        more = np.logaddexp.reduce(step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where((t + 1 < length)[:, None], more, 0.0)
    whole = np.logaddexp.reduce(ahead[np.arange(n), length - 1], axis=1)
    inside = np.arange(longest) < length[:, None]
    # Beyond a sequence's end the scores mean nothing and may be of any size, so they are left out before the exponential.
    lines = np.exp(np.where(inside[:, :, None], ahead + behind - whole[:, None, None], -np.inf))
    steps = np.zeros((2, 2))
    if longest > 1:
        pairs = (
            ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        )
        both = inside[:, 1:]
        steps += np.exp(np.where(both[:, :, None, None], np.minimum(pairs, 0.0), -np.inf)).sum((0, 1))
        np.add.at(steps, (wanted[:, :-1][both], wanted[:, 1:][both]), -1.0)
    rows, cols = np.nonzero(inside)
    lines[rows, cols, wanted[rows, cols]] -= 1.0
    return lines, steps
