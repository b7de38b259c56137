"""Vocabulary files: read once on the driver, size-checked, and sent to the tasks as one broadcast.

Texts are cut into pieces that no tokenizer here looks across, and each worker remembers the encoding of the pieces
it has met; a full memory loses its later half, so its size is bounded and results never depend on it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import islice

import regex
from pyspark.sql import SparkSession

#: Vocabulary files are a few MB; anything larger isn't broadcast.
MAX_VOCAB_BYTES = 64 << 20
#: Pieces a worker remembers (about 250 bytes each), and the longest piece it remembers.
MEMORY_PIECES, MEMORY_PIECE_CHARS = 1_000_000, 64


def broadcast_file(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


#: One built object for each broadcast in a worker process.
_built: dict = {}


def built(broadcast, make: Callable[[bytes], object]):
    """make(data) once for each worker process."""
    key = (broadcast._path if hasattr(broadcast, "_path") else id(broadcast), make.__qualname__)
    if key not in _built:
        _built.clear()
        _built[key] = make(broadcast.value)
    return _built[key]


def words(text: str) -> list[str] | None:
    """The text cut before every space and around every newline, if all its white space stands singly between words.

    A word that followed a newline starts with it; the space before any other word but the first is left out. Such cuts
    change no token, as the byte-level pattern gives a single space to the word behind it and a single newline to
    itself. None for other texts, which are then encoded whole.
    """
    if " ".join(text.split()) != text.replace("\n", " "):
        return None
    return text.replace("\n", " \n").split(" ")


class Pieces:
    """Matches of a pattern. Unassigned code points count as no letters, as in the tokenizers' own pattern engines."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and (odd := [c for c in set(text) if unicodedata.category(c) == "Cn"]):
            stand_in = text.translate(dict.fromkeys(map(ord, odd), "\ue000"))
            return [text[m.start() : m.end()] for m in self.pattern.finditer(stand_in)]
        return self.pattern.findall(text)


class Memory:
    """Results by piece; `fill` gives those of a list of new pieces."""

    def __init__(self, fill: Callable[[list[str]], list], most: int = MEMORY_PIECES):
        self.fill, self.known, self.most = fill, {}, most

    def look_up(self, pieces: list[str]) -> list:
        out = list(map(self.known.get, pieces))
        if None in out:
            gaps = [i for i, x in enumerate(out) if x is None]
            new = list({pieces[i] for i in gaps})
            got = dict(zip(new, self.fill(new), strict=True))
            self.remember(got)
            for i in gaps:
                out[i] = got[pieces[i]]
        return out

    def remember(self, got: dict) -> None:
        self.make_room(len(got))
        self.known.update((p, x) for p, x in got.items() if len(p) <= MEMORY_PIECE_CHARS)

    def make_room(self, n: int) -> None:
        """If n more pieces are too many, the first half stays: common pieces come early."""
        if len(self.known) + n > self.most:
            self.known = dict(islice(self.known.items(), self.most // 2))
