"""Byte-level BPE by a monoid tree reduction, and the inverse.

A piece is halved recursively; two encoded neighbours are joined by re-encoding a window around their boundary that
grows until its outermost tokens come back unchanged. Every pair of neighbouring tokens is then a pair that encodes to
itself, which holds only for the encoding of the whole, so tokens outside the window stay as they are. Decoding
concatenates byte strings up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship
from .vocab import Memory, Pieces, broadcast_file, built, words

#: Up to this many bytes the lowest-ranked merges are done directly; ids that decoding joins at a leaf.
LEAF_BYTES, LEAF_IDS = 16, 256
#: Words that a worker remembers.
MEMORY_WORDS = 600_000
#: Rows whose ids are held at once.
ROWS_AT_ONCE = 500


class TreeBpe:
    """Encoder and decoder for a rank file; pieces are the matches of `pattern`."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.text_of = {v: str(v) for v in self.bytes_of}
        self.pieces = Pieces(pattern)
        self.memory = Memory(lambda new: [self._word(w) for w in new], MEMORY_WORDS)

    def leaf(self, data: bytes) -> list[int]:
        """Merges of the lowest-ranked neighbouring pair, the leftmost first, until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            low, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two token lists' bytes together."""
        i = j = 1
        while True:
            old = left[-i:] + right[:j]
            new = self.window(b"".join(map(self.bytes_of.__getitem__, old)))
            start, end = i >= len(left), j >= len(right)
            left_holds, right_holds = start or new[0] == old[0], end or new[-1] == old[-1]
            if left_holds and right_holds and (len(new) > 1 or (start and end) or len(old) == 1):
                return left[:-i] + new + right[j:]
            if not left_holds or (len(new) == 1 and not start):
                i = min(2 * i, len(left))
            if not right_holds or (len(new) == 1 and not end):
                j = min(2 * j, len(right))

    def window(self, data: bytes) -> list[int]:
        """Merges over a heap for long windows: a window may be a whole piece, which halves can't make smaller."""
        if len(data) <= 4 * LEAF_BYTES:
            return self.leaf(data)
        ranks, n = self.ranks, len(data)
        if (whole := ranks.get(data)) is not None:
            return [whole]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place; end 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # a part has been merged meanwhile
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        return [ranks[data[i : end[i]]] for i in range(n) if end[i]]

    def encode_piece(self, data: bytes) -> list[int]:
        """Bottom-up over leaves, so very long pieces need no deep recursion."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        level = [self.leaf(data[i : i + LEAF_BYTES]) for i in range(0, len(data), LEAF_BYTES)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def _word(self, word: str) -> bytes:
        """A word's ids as packed numbers, which take little memory."""
        word = word.removeprefix("\0") if word[:1] == "\0" else word if word[:1] == "\n" else " " + word
        return array("I", chain.from_iterable(self.encode_piece(p.encode()) for p in self.pieces(word))).tobytes()

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def packed(self, text: str) -> array:
        """The ids as 32-bit numbers, which take a tenth of a list's memory."""
        found = words(text) if "\0" not in text else None
        if found is None:
            return array("I", chain.from_iterable(self.encode_piece(p.encode()) for p in self.pieces(text)))
        if found[0][:1] != "\n":
            found[0] = "\0" + found[0]  # no space before it
        return array("I", b"".join(self.memory.look_up(found)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: leaves of some ids each, whose neighbours are concatenated level by level up the tree."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + LEAF_IDS])) for i in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row of `docs`: its id, n_tokens, ids_sha256 and decoded_sha256, and with `with_ids` the list `ids`.

    Null and empty texts have no tokens; both digests are then those of the empty string. Repeated rows and null ids
    are passed on row by row; other columns are left out.
    """
    ship(docs.sparkSession)
    data = broadcast_file(docs.sparkSession, vocab_path)

    def make(raw: bytes) -> TreeBpe:
        return TreeBpe(raw, pattern)

    def run(batches):
        bpe = built(data, make)
        for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, max(1, len(whole)), ROWS_AT_ONCE)):
            rows, packed = [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.packed(t) if t else array("I")
                rows.append((len(ids), hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
                if with_ids:
                    packed.append(ids.tobytes())
            cols = list(zip(*rows, strict=True)) or [()] * 3
            out = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *cols[0]]).astype(np.int32)
                out, names = [*out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
