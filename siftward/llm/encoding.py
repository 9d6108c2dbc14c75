"""Pieces of texts and their tokens, for the operators that use a public tokenizer.

A vocabulary file is read on the driver and broadcast (a few MB whatever the corpus),
so executors need no copy of it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import SparkSession

#: White space by Unicode. A boundary before such a character, where none stands before
#: it, is safe: no token of a byte-level or word tokenizer goes across it.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: What makes a blank unsafe as a boundary: white space right before it.
BLANKS = (b"  ", b"\n ", b"\t ", b"\r ", b"\v ", b"\f ")
WIDE_BLANK = re.compile(
    rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80) "
)
STOPS = b".,!?;:"
CHUNK = 1 << 20
ENCODE_BYTES = 256 << 10
CACHE_PIECES, CACHE_BYTES = 1_200_000, 24 << 20

_loaded: dict[tuple, object] = {}


def vocabulary(spark: SparkSession, path: str):
    """The file at ``path``, broadcast."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def for_worker(source, kind: type, *arguments):
    """``kind`` of the tokenizer of a broadcast file, one for each worker process.

    Workers run one task after another, which thus share what earlier ones have encoded.
    """
    text = source.value
    key = (hash(text), kind, arguments)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(tokenizer(text), *arguments)
    return _loaded[key]


def tokenizer(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


def splits_at_blanks(definition: str) -> bool:
    """Whether the tokenizer of this JSON cuts at white space before it merges.

    True for byte-level splitting by its usual pattern, where a blank starts a piece, without
    a normalizer; any other tokenizer gets whole texts.
    """
    kinds = json.loads(definition)
    pre = kinds.get("pre_tokenizer") or {}
    return (
        not kinds.get("normalizer")
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
    )


def drops_blanks(definition: str) -> bool:
    """Whether white space only separates words and leaves no token, as in the word BPE files."""
    kinds = json.loads(definition)
    steps = (kinds.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    return (
        steps[0].get("type") == "Split"
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert") is True
        and pattern.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
    )


def word_end(definition: str) -> str | None:
    """What marks the last token of a word in the vocabulary."""
    return (json.loads(definition).get("model") or {}).get("end_of_word_suffix") or None


def stem_and_tail(word: bytes) -> tuple[bytes, bytes]:
    """A word and the stops after it, in pieces whose tokens are those of the word.

    For tokenizers of lower case that part letters and digits from other characters. Stops are cut off an ASCII letter or
    digit only, and only plain ASCII words are lowered, so that marker strings keep their case.
    """
    stem = word.rstrip(STOPS)
    if not stem or stem == word or not stem[-1:].isalnum():
        stem = word
    return stem.lower() if stem.isalpha() else stem, word[len(stem) :]


#: First bytes of combining marks, with which lower case does not go letter by letter.
COMBINING = (b"\xcc", b"\xcd")


def added_tokens(definition: str) -> tuple[bytes, ...]:
    """Lower case of the marker strings that a tokenizer finds before all else."""
    found = json.loads(definition).get("added_tokens") or []
    return tuple(sorted(t["content"].encode().lower() for t in found if t.get("content")))


#: Kinds of bytes of lower-case texts: what may stand before a stop, stops, what may follow them.
BEFORE, STOP, AFTER = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = BEFORE
KINDS[list(STOPS)] = STOP
KINDS[list(b" \t\n\v\f\r")] = AFTER


def is_plain(lower: bytes, added: tuple[bytes, ...]) -> bool:
    """No marker string, whose case would count, and no combining marks."""
    return not any(x in lower for x in COMBINING) and not any(x in lower for x in added)


def stems_and_tails(lower: list[bytes]) -> list[list[bytes]]:
    """What ``stem_and_tail`` gives for all words of plain lower-case texts, one after another.

    A blank is set before each run of stops that stands behind a letter or digit and ends a word, in all texts at once.
    """
    whole = np.frombuffer(b"\n".join(lower) + b"\n", np.uint8)
    kind = KINDS[whole]
    stop = kind == STOP
    first = np.flatnonzero(stop[1:] & (kind[:-1] == BEFORE)) + 1
    last = np.flatnonzero(stop[:-1] & ~stop[1:])
    cut = first[kind[last[np.searchsorted(last, first)] + 1] == AFTER] if len(first) else first
    spaced = np.insert(whole, cut, 32).tobytes()
    ends = np.cumsum([len(x) + 1 for x in lower])
    ends += np.searchsorted(cut, ends)
    return [spaced[a:b].split() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def is_one_word(piece: bytes) -> bool:
    """Whether a piece has nothing but letters, of scripts whose lower case is one letter each."""
    if piece.isalpha():
        return True
    text = piece.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


def chunks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text in parts that begin at a blank; for texts where each blank is a safe boundary."""
    start = 0
    while (cut := text.find(b" ", start + size)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


def safe_blanks(text: bytes) -> bool:
    """Whether no blank of the text stands behind other white space."""
    if any(x in text for x in BLANKS):
        return False
    return text.isascii() or not WIDE_BLANK.search(text)


class Cache:
    """Values of pieces, computed in batches of even bytes, within bounds of number and size."""

    def __init__(
        self, values: Callable[[list[bytes]], Iterable], pieces: int = CACHE_PIECES, batch_bytes: int = ENCODE_BYTES
    ):
        self.values, self.pieces, self.batch_bytes = values, pieces, batch_bytes
        self.known: dict[bytes, object] = {}
        self.bytes = 0

    def of(self, needed: set[bytes]) -> dict[bytes, object]:
        """A mapping with all needed pieces."""
        missing = needed.difference(self.known)
        more = sum(map(len, missing))
        if len(self.known) + len(missing) > self.pieces or self.bytes + more > CACHE_BYTES:
            # Frequent pieces are among those needed now, and stay.
            self.known = {p: self.known[p] for p in needed.difference(missing)}
            self.bytes = sum(map(len, self.known))
        self.bytes += more
        batch, size = [], 0
        for piece in sorted(missing, key=len):
            if batch and size + len(piece) > self.batch_bytes:
                self.known.update(zip(batch, self.values(batch)))
                batch, size = [], 0
            batch.append(piece)
            size += len(piece)
        if batch:
            self.known.update(zip(batch, self.values(batch)))
        return self.known
