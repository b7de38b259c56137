"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks; a chunk is stored once under its SHA-256. A
document's recipe lists its chunks with their end positions; recipes stand in ascending id order, in parts that follow
each other. The manifest holds Merkle roots: over ranges of 2^12 recipes of a part, over a part's ranges and over all
parts, each with its counts. What is read is checked against it.

Layout of a store folder: `data/kind=chunk` (key, payload), `data/kind=doc` (unordered recipes, the writer's own
notes), `recipes` (part, at, doc_id, start within the part, n_tokens, ends, digests, root), `manifest` (level, part,
block, n_docs, n_tokens, start, id_bytes, root).
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, read_table, ship, written
from .vocab import MEMORY_PIECE_CHARS, Memory, broadcast_file, built

#: Ids under the rolling hash, and chunk lengths: 2^MEAN_BITS expected beyond the least.
WINDOW, LEAST, MEAN_BITS, MOST = 16, 128, 9, 4096
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_U64 = np.uint64
MANIFEST_BITS = 12
DATA = "kind string, key binary, doc_id bigint, n_tokens bigint, ends array<int>, digests array<binary>, root binary, payload binary"


#: Words without white space to any engine, after a lead: visible ASCII and letters of the first Unicode versions.
PLAIN = re.compile("[\n\0]?[!-~ªµºÀ-ÖØ-öø-ɏ]+")
#: Characters of texts that are cut into words at once.
SLICE_CHARS = 1 << 22


class IdEncoder:
    """Token ids of whole texts by the tokenizers library.

    Texts whose white space is single spaces and newlines between words are cut there, as no piece of the byte-level
    pattern reaches over it, and each distinct word is encoded once; other texts go to the library whole.
    """

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code, self.dtype = ("I", np.dtype("<u4")) if wide else ("H", np.dtype("<u2"))
        pre = self.tokenizer.pre_tokenizer
        self.by_words = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None and not any(len(t.split()) != 1 or t != t.strip() for t in self.special)
        self.memory, self.newline = Memory(self._words), self.whole(["\n"])[0]
        self.by_words = self.by_words and len(self.newline) == self.dtype.itemsize

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, new: list[str]) -> list[bytes]:
        """Ids of words: led by a newline, by a zero byte at the start of a text, else by a space. No ids: not a word."""
        out, plain, lines, rest = [b""] * len(new), [], [], []
        match, newline, size = PLAIN.fullmatch, self.newline, self.dtype.itemsize
        for i, w in enumerate(new):
            if match(w):
                plain.append(i)
                lines.append(w[1:] if w[0] in "\n\0" else " " + w)
            elif (body := w[1:] if w[:1] in ("\n", "\0") else w).split() == [body]:
                rest.append(i)
        # plain words are encoded as the lines of one text: a single newline is a piece of its own, and its id no other's
        if lines:
            data = self.whole(["\n".join(lines)])[0] + newline
            at = 0
            ends = np.flatnonzero(np.frombuffer(data, self.dtype) == np.frombuffer(newline, self.dtype)[0]) * size
            for i, end in zip(plain, ends.tolist(), strict=True):
                out[i] = newline + data[at:end] if new[i][0] == "\n" else data[at:end]
                at = end + size
        for i, ids in zip(rest, self.whole([new[i].removeprefix("\0") if new[i][0] in "\n\0" else " " + new[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        out = list(map(self.memory.known.get, words))
        gaps = [i for i, x in enumerate(out) if x is None]
        self.memory.make_room(len(gaps))
        known = self.memory.known
        for i, ids in zip(gaps, self._words([words[i] for i in gaps]), strict=True):
            out[i] = ids
            if len(words[i]) <= MEMORY_PIECE_CHARS:
                known[words[i]] = ids
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = [np.empty(0, self.dtype)] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_words or "\0" in t or any(s in t for s in self.special):
                out[i] = np.frombuffer(self.whole([t])[0], self.dtype)
                continue
            held.append(i)
            size += len(t)
            if size >= SLICE_CHARS:
                self._by_words(texts, held, out)
                held, size = [], 0
        if held:
            self._by_words(texts, held, out)
        return out

    def _by_words(self, texts: list[str], held: list[int], out: list[np.ndarray]) -> None:
        cut = pc.split_pattern(pa.array(["\0" + texts[i].replace("\n", " \n") for i in held], pa.large_string()), " ")
        distinct = cut.flatten().dictionary_encode()
        known = self._known(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, known), np.int32, len(known)) // self.dtype.itemsize
        starts, data = np.cumsum(lengths, dtype=np.int32) - lengths, np.frombuffer(b"".join(known), self.dtype)
        at = distinct.indices.to_numpy()
        n = lengths[at]
        ends = np.cumsum(n, dtype=np.int32)  # a slice's ids are far fewer than 2^31
        ids = data[np.repeat(starts[at] - ends + n, n) + np.arange(int(ends[-1]), dtype=np.int32)]
        first = cut.offsets.to_numpy()
        odd = np.logical_or.reduceat(n == 0, first[:-1])
        bounds = np.append(0, ends)[first]
        for k, i in enumerate(held):
            out[i] = np.frombuffer(self.whole([texts[i]])[0], self.dtype) if odd[k] else ids[bounds[k] : bounds[k + 1]]


_powers = np.ones(1, _U64), np.ones(1, _U64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    global _powers
    if len(_powers[0]) <= n:
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(2 * n + 1, b, _U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = tuple(made)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def chunk_ends(ids: np.ndarray) -> list[int]:
    """End positions of the chunks: after an id whose window's hash has MEAN_BITS leading zeros, or at MOST ids."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    up, down = _power(n)
    mixed = (ids.astype(_U64) + _U64(1)) * _U64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> _U64(29)
    total = np.zeros(n + 1, _U64)
    np.cumsum(mixed * down[:n], out=total[1:])
    rolled = (total[WINDOW:] - total[:-WINDOW]) * up[WINDOW - 1 : n]
    rolled ^= rolled >> _U64(32)
    rolled *= _U64(0xC2B2AE3D27D4EB4F)
    out, last = [], 0
    for c in (np.flatnonzero(rolled >> _U64(64 - MEAN_BITS) == 0) + WINDOW).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + leaves[i] + leaves[i + 1]).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _crc_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo the CRC-32 polynomial."""
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s as they count in that of a longer string with n_bytes behind; the CRC of a string is the XOR of its parts'."""
    out, power = crc.astype(np.uint32), np.array([1 << 23], np.uint32)  # x^8
    n = n_bytes.astype(np.int64)
    while n.any():
        out = np.where(n & 1, _crc_mul(np.broadcast_to(power, out.shape), out), out)
        power, n = _crc_mul(power, power), n >> 1
    return out


def write_store(docs: DataFrame, path: str, vocab_path: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> None:
    """Encodes every row of `docs` and writes a store under `path`.

    Null and empty texts give just the end id. Equal ids are ordered by root and kept apart; rows with a null id come
    first. Other columns are left out. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    ship(spark)
    data = broadcast_file(spark, vocab_path)
    names = ["kind", "key", "doc_id", "n_tokens", "ends", "digests", "root", "payload"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()]

    def run(batches):
        from pyspark import TaskContext

        encoder, seen, row = built(data, IdEncoder), set(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for key, found in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).to_pylist()), strict=True):
                ids = np.append(found, np.array(end_id, encoder.dtype))
                ends, digests, last = chunk_ends(ids), [], 0
                for end in ends:
                    payload = ids[last:end].tobytes()
                    digests.append(digest := hashlib.sha256(payload).digest())
                    last = end
                    if digest not in seen:  # as many as a task's input has chunks
                        seen.add(digest)
                        out.append(("chunk", digest, None, None, None, None, None, payload))
                out.append(("doc", f"{task}-{row}".encode(), key, len(ids), ends, digests, merkle_root(digests), None))
                row += 1
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 2000], strict=True), kinds, strict=True)], names)

    # dealt out first, so that payloads are sorted once
    rows = docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, DATA).repartition("key").dropDuplicates(["kind", "key"])
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    notes = spark.read.schema(DATA).parquet(f"{path}/data").where("kind = 'doc'").select("key", "doc_id", "n_tokens", "ends", "digests", "root")
    order = ["doc_id", "root", "key"]
    notes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    wide = built_width(spark, vocab_path)
    manifest(spark, path).withColumn("id_bytes", F.lit(wide)).write.option("compression", "zstd").parquet(f"{path}/manifest")


def built_width(spark: SparkSession, vocab_path: str) -> int:
    """Bytes of a stored id."""
    with open(vocab_path, "rb") as f:
        return IdEncoder(f.read()).dtype.itemsize


RECIPES = "part int, at bigint, doc_id bigint, start bigint, n_tokens bigint, ends array<int>, digests array<binary>, root binary"


def _numbered(batches):
    """Numbers the sorted rows of a part and sums up their tokens."""
    from pyspark import TaskContext

    part, at, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        ends = np.cumsum(n) + start
        places = [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(at, at + len(n))), batch.column(1), pa.array(ends - n)]
        yield pa.RecordBatch.from_arrays([*places, *(batch.column(i) for i in range(2, 6))], ["part", "at", "doc_id", "start", "n_tokens", "ends", "digests", "root"])
        at, start = at + len(n), int(ends[-1]) if len(n) else start


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Roots and counts of the store's recipes: level 1, ranges of 2^12 of a part; level 2, parts; level 3, the store.

    Parts are as many as the writer's partitions, so their table is small; `start` counts the ids of the parts before.
    """
    leaf = F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "start", "n_tokens", F.hex("root")), 256)
    nodes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", F.shiftright("at", MANIFEST_BITS).alias("block"), "at", "n_tokens", F.lit(1).cast("long").alias("n_docs"), leaf.alias("root"))

    def level(nodes: DataFrame, n: int, at: str, *keys: str) -> DataFrame:
        root = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "root"))), lambda x: x["root"]), ","), 256)
        sums = nodes.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), root.alias("root"))
        free = [F.lit(None).cast("bigint" if k == "block" else "int").alias(k) for k in ("part", "block") if k not in keys]
        return sums.select(F.lit(n).alias("level"), "*", *free)

    blocks = written(level(nodes, 1, "at", "part", "block"), "manifest-blocks")
    parts = level(blocks, 2, "block", "part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    top = level(parts, 3, "part").where("n_docs > 0")
    names = ["level", "part", "block", "n_docs", "n_tokens", "start", "root"]
    with_start = parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return with_start.select(*names).unionByName(blocks.withColumn("start", F.lit(None).cast("long")).select(*names)).unionByName(top.withColumn("start", F.lit(0).cast("long")).select(*names))


def _recipes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The recipes with `start` counted from the store's first id, and the bytes of an id; checked against the manifest."""
    stored = spark.read.parquet(f"{path}/manifest")
    now, then = manifest(spark, path), stored.drop("id_bytes")
    found = now.withColumn("sign", F.lit(1)).unionByName(then.withColumn("sign", F.lit(-1)))
    if not found.groupBy(*then.columns).agg(F.sum("sign").alias("d")).where("d <> 0").isEmpty():
        raise ValueError(f"the recipes under {path} don't agree with the manifest")
    width = stored.agg(F.max("id_bytes")).first()[0] or 2
    parts = F.broadcast(stored.where("level = 2").select(F.col("part").alias("of"), F.col("start").alias("base")))  # a row for each writing task
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").join(parts, F.col("part") == F.col("of"))
    return recipes.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ends", "digests", "root"), width


def _exploded(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document: the ids behind it, and whether the document's digests give its root."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, start, n, ends, digests, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sound = merkle_root(digests) == root and len(ends) == len(digests) and (ends[-1] if ends else 0) == n
                rows += [(doc_id, start, d, e, n - e, sound) for d, e in zip(digests, ends, strict=False)]
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows[i : i + 5000], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()), strict=True)],
                    ["doc_id", "start", "digest", "end", "after", "sound"])

    return recipes.select("doc_id", "start", "n_tokens", "ends", "digests", "root").mapInArrow(run, "doc_id bigint, start bigint, digest binary, end int, after bigint, sound boolean")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens and ids_crc32, from the stored chunks.

    Every chunk is read once, checked against its digest and reduced to its CRC-32; documents put their chunks' CRCs
    together in the order of their recipes, so chunks themselves aren't moved. A recipe that is lost, changed or moved,
    a digest, root or length that doesn't hold raises an error.
    """
    ship(spark)
    recipes, id_bytes = _recipes(spark, path)

    def facts(batches):
        for batch in batches:
            keys, n, crc, ok = batch.column(0).to_pylist(), [], [], []
            for key, payload in zip(keys, batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(payload, f"<u{id_bytes}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                ok.append(hashlib.sha256(payload).digest() == key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], ["digest", "n", "crc", "ok"])

    def placed(batches):
        for batch in batches:
            crc, after = batch.column(5).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            term = crc_shifted(crc, 4 * after).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), pa.array(term, pa.int64())], ["doc_id", "start", "sound", "n", "term"])

    chunks = spark.read.schema(DATA).parquet(f"{path}/data").where("kind = 'chunk'").select("key", "payload").mapInArrow(facts, "digest binary, n bigint, crc bigint, ok boolean")
    parts = _exploded(recipes).join(chunks, "digest", "left")
    parts = parts.select("doc_id", "start", "after", (F.col("sound") & F.coalesce("ok", F.lit(False))).alias("sound"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"))
    terms = parts.mapInArrow(placed, "doc_id bigint, start bigint, sound boolean, n bigint, term bigint")
    out = terms.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.expr("bit_xor(term)").alias("ids_crc32"), F.bool_and("sound").alias("sound"))
    checked = F.when(F.col("sound"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a chunk or a root of the store does not verify")).cast("long"))
    return out.select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start and its list `ids`, put together from its chunks."""
    ship(spark)
    recipes, id_bytes = _recipes(spark, path)

    def unpack(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), f"<u{id_bytes}").astype("<i4") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    chunks = spark.read.schema(DATA).parquet(f"{path}/data").where("kind = 'chunk'").select(F.col("key").alias("digest"), "payload")
    parts = _exploded(recipes).join(chunks, "digest", "left")
    whole = parts.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("end", "payload"))).alias("p"))
    return whole.select("doc_id", "start", F.col("p.payload").alias("p")).mapInArrow(unpack, "doc_id bigint, start bigint, ids array<int>")


def op1_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return verified(spark, path)
