"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts by language and bucket are summed by Spark over all labelled rows; the matrix of log probabilities, whose size
is checked, is broadcast, and texts are scored in numpy batches of bounded length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: Entries of the broadcast matrix (float32): 1,024 languages. More are an error, never a coarser model.
MAX_ENTRIES = 1 << 25
#: Characters of a run, and entries of the matrix that are gathered at once.
BATCH_CHARS, GATHERED = 1 << 18, 1 << 23
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(run: np.ndarray, before: int = 0) -> np.ndarray:
    """Buckets of the n-grams of the orders, of a run of code points, that end after its first `before`."""
    out = []
    for n in ORDERS:
        chars = run[max(0, before - n + 1) :]
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ chars[k : len(chars) - n + 1 + k]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def code_points(text: str, size: int | None = None) -> list[tuple[np.ndarray, int]]:
    """Lower-cased code points in runs of at most `size` (BATCH_CHARS), behind the last ones of the run before, with their number.

    So each n-gram of the text ends in one run, after what comes from the run before.
    """
    chars, over = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4"), max(ORDERS) - 1
    size = size or BATCH_CHARS
    return [(chars[max(0, i - over) : i + size], min(i, over)) for i in range(0, len(chars), size)]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts by lang and bucket, with the number of texts of the language in bucket -1. Null texts or langs don't count."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def rows():
            for name, c in counts.items():
                at = np.flatnonzero(c)
                at, c = np.append(at, -1), np.append(c[at], texts[name])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c, pa.int64())], ["lang", "bucket", "n"])

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in counts:
                    if len(counts) >= 64:  # bounds a task's memory
                        yield from rows()
                        counts.clear()
                    counts[name], texts[name] = np.zeros(1 << BUCKET_BITS, np.int64), 0
                texts[name] += 1
                for chars, before in code_points(t):
                    counts[name] += np.bincount(ngram_buckets(chars, before), minlength=1 << BUCKET_BITS)
        yield from rows()

    picked = labelled.select(F.col(text), F.col(lang).cast("string")).dropna()
    return picked.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in ascending order and the log probabilities of their buckets."""

    def __init__(self, counts: DataFrame, smoothing: float = 0.5):
        counts = counts.persist()
        try:
            prior = {r["lang"]: r["n"] for r in counts.where("bucket = -1").collect()}
            self.langs = sorted(prior)
            if len(self.langs) << BUCKET_BITS > MAX_ENTRIES:
                raise ValueError(f"{len(self.langs)} languages need a matrix of more than {MAX_ENTRIES} entries")
            places = F.create_map(*(F.lit(x) for pair in zip(self.langs, range(len(self.langs)), strict=True) for x in pair)) if self.langs else F.create_map().cast("map<string,int>")
            table = counts.where("bucket >= 0").select("bucket", places[F.col("lang")].alias("at"), "n").toArrow()  # numbers only
        finally:
            counts.unpersist()
        matrix = np.zeros((1 << BUCKET_BITS, max(1, len(self.langs))))
        bucket, at, n = (table.column(i).to_numpy() for i in range(3))
        matrix[bucket.astype(int), at.astype(int)] = n
        matrix += smoothing
        self.log_p = np.log(matrix / matrix.sum(0)).astype(np.float32)
        self.prior = np.log(np.array([prior[x] for x in self.langs], float) / sum(prior.values())) if self.langs else np.zeros(1)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row of `docs`: its id, the columns `keep`, lang_pred and score, the posterior of lang_pred.

    Null texts, texts without a letter, and all texts if no language was learned: `und` with score 0. Equal posteriors
    go to the first language in order. Repeated rows and null ids are passed on row by row.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p, model.prior))

    def run(batches):
        langs, log_p, prior = sent.value
        at_once = min(BATCH_CHARS, max(64, GATHERED // (len(ORDERS) * log_p.shape[1])))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total = np.tile(prior, (len(texts), 1))
            runs, owners, size = [], [], 0

            def score():
                if runs:
                    grams = [ngram_buckets(*r) for r in runs]
                    lengths = np.array([len(g) for g in grams])
                    sums = np.add.reduceat(log_p[np.concatenate(grams)], np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)
                    np.add.at(total, owners, sums)
                    runs.clear(), owners.clear()

            told = [bool(t) and bool(langs) and any(map(str.isalpha, t)) for t in texts]
            for i, t in enumerate(texts):
                for chars, before in code_points(t, at_once) if told[i] else []:
                    runs.append((chars, before))
                    owners.append(i)
                    size += len(chars)
                    if size >= at_once:
                        score()
                        size = 0
            score()
            best = total.argmax(1) if len(texts) else np.empty(0, int)
            top = total.max(1, keepdims=True) if len(texts) else total
            p = 1 / np.exp(total - top).sum(1)
            names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, told, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(np.where(told, p, 0.0), pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    picked = docs.select(F.col(text).alias("__text"), F.col(id_col), *[c.alias(n) for n, c in (keep or {}).items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = Model(fit(docs.where(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())))
    return predict(docs, model, keep={"held_out": held_out})
