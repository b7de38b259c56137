"""Token counts by byte-pair merging over a heap and a linked list, without making any identifier.

The symbols of a word form a linked list, and a heap holds the ranks of neighbouring pairs; the lowest pair is popped
and merged until none is left. The count is the number of initial symbols less the number of merges.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .vocab import Memory, Pieces, broadcast_file, built


class WordBpeCounter:
    """Counts of a BPE whose words end in a suffix, from the JSON form that the tokenizers library reads."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.vocab = set(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = Pieces(steps[0]["pattern"]["Regex"])
        normalizer = Tokenizer.from_str(raw.decode()).normalizer
        self.normal = normalizer.normalize_str if normalizer else lambda t: t
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # str.split also splits at four control characters that aren't white space to the tokenizer
        self.separators = set("\x1c\x1d\x1e\x1f")
        self.split = regex.compile(r"[^\s\x1c-\x1f]*(?:[\x1c-\x1f]+[^\s\x1c-\x1f]*)*").findall
        # printable stand-ins of the 256 bytes, as byte-level vocabularies use them
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.memory = Memory(lambda new: [self.count_run(w) for w in new])

    def count_word(self, word: str) -> int:
        symbols = [self.stand_in[b] for b in word.encode()]
        symbols[-1] += self.suffix
        symbols = [s for s in symbols if s in self.vocab]  # no unknown token: such symbols give none
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank, heap = self.rank, []
        for i in range(n - 1):
            if (r := rank.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # a side has been merged meanwhile
            symbols[i], symbols[j] = a + b, None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def count_run(self, run: str) -> int:
        """Tokens of a run without white space and special strings."""
        return sum(self.count_word(w) for w in self.words(self.normal(run)))

    def runs(self, text: str) -> list[str]:
        return text.split() if self.separators.isdisjoint(text) else self.split(text)

    def count(self, text: str) -> int:
        """Tokens of a text. White space separates words and gives no token, so runs between it are counted apart."""
        found = 0
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            found, runs = len(parts) - 1, [r for p in parts for r in self.runs(p)]
        else:
            runs = self.runs(text)
        return found + sum(self.memory.look_up(runs))


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: its id, n_bytes, n_tokens and over_limit (n_tokens > `limit`).

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are passed on row by row; other columns
    are left out.
    """
    data = broadcast_file(docs.sparkSession, vocab_path)

    def run(batches):
        counter = built(data, WordBpeCounter)
        for batch in batches:
            n = [counter.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    counted = picked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
