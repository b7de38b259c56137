"""Removal of passages that occur again, by a Burrows-Wheeler transform with threshold-bounded interval expansion.

Spark brings together what can be equal: in every window of `length` bytes the least hash of its k-byte strings is an
anchor, so equal windows have equal anchors at equal places. Windows in a row with one anchor form a run; anchors that
occur once, and runs that occur again as a whole, are settled by counting. The other runs meet by anchor. A task
concatenates the runs of whole anchors into a text of bounded size, sorts its suffixes by their first bytes and extends
intervals of the transform breadth-first to the left: boundaries get their common prefix by increasing value, and those
that have none when `length` is reached separate suffixes that share a window.

Anchors with more distinct runs than a task should hold are split: their runs are cut at fixed distances from the anchor
and meet by the bytes that a part's windows share, again and again until few enough meet for a transform. Cells of a
single window need none, as these are equal or not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, written
from .topk_search import small_batches

LENGTH, GRAM = 400, 48
#: Distinct runs of an anchor that one task compares, and bytes of a text that is transformed at once.
MOST_RUNS, TEXT_BYTES = 400, 1 << 17
#: Counts of symbols that an expansion holds at once.
COUNTED = 1 << 21
#: Bytes of a text hashed at once; windows never depend on the cut.
SEGMENT = 1 << 21
#: Parts into which a run of a very common anchor is split in a round.
SPLIT = 4
_U64 = np.uint64
_BASE = 0xA0761D6478BD642F
_powers = [np.ones(1, _U64), np.ones(1, _U64)]


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all `gram`-byte strings."""
    n = len(data)
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n + n // 2, b, _U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    total = np.zeros(n + 1, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * _powers[0][:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _powers[1][: n - gram + 1]
    h = (h ^ (h >> _U64(32))) * _U64(0xE7037ED1A0B428DB)
    return h ^ (h >> _U64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least of every `width` hashes in a row, the first of equal ones."""
    n = len(h)
    place_bits = _U64(22)
    keyed = ((h >> place_bits) << place_bits) | np.arange(n, dtype=_U64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, _U64)
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[: n - width + 1], before[width - 1 : n]) & _U64((1 << 22) - 1)).astype(np.int64)


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(anchor, first window, last window, the anchor's place) of every run of windows with one anchor."""
    out = []
    for base in range(0, max(1, len(data) - length + 1), SEGMENT):
        part = np.frombuffer(data, np.uint8)[base : base + SEGMENT + length - 1]
        if len(part) < length:
            break
        h = _hashes(part, gram)
        at = _least(h, length - gram + 1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        out += zip(h[at[first]].astype(np.int64).tolist(), (first + base).tolist(), (last + base).tolist(), (at[first] + base).tolist(), strict=True)
    return out


def _counter(last: np.ndarray, n_symbols: int):
    """A function of places i: how often each symbol but the first stands before them.

    Bits mark each symbol's places in words of 64; sums stand before each word, so a text of n symbols takes
    12 * n_symbols / 64 bytes a symbol.
    """
    n_words = len(last) // 64 + 1
    at = np.arange(len(last))
    bits = np.zeros(n_symbols * n_words, _U64)
    np.bitwise_or.at(bits, last * n_words + (at >> 6), _U64(1) << (at & 63).astype(_U64))
    bits = bits.reshape(n_symbols, n_words)[1:]
    sums = np.bitwise_count(bits).astype(np.int32)
    sums = np.cumsum(sums, axis=1, dtype=np.int32) - sums

    def count(i: np.ndarray) -> np.ndarray:
        word, mask = i >> 6, (_U64(1) << (i & 63).astype(_U64)) - _U64(1)
        return sums[:, word] + np.bitwise_count(bits[:, word] & mask)

    return count


def repeated_windows(runs: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each run, whether each of its windows occurs at another place of the runs too."""
    sizes = np.array([len(r) for r in runs])
    text = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8).astype(np.uint64) + _U64(1)
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    n = len(text)
    rest = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes up to the end of the run
    # order by the first 7 symbols, then by three times as many, or twice as many in long texts, until `length` is reached
    key = np.zeros(n, _U64)
    for i in range(7):
        key = (key << _U64(9)) | np.append(text[i:], np.zeros(i, _U64))
    done, times, bits = 7, *((3, _U64(21)) if n < 1 << 21 else (2, _U64(32)))
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, _U64)
        rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])).astype(_U64)
        if done >= length or rank[order[-1]] == n:
            break
        key = rank
        for i in range(1, times):
            key = (key << bits) | np.append(rank[i * done :], np.zeros(min(i * done, n), _U64))[:n]
        done *= times
    symbols, dense = np.unique(text, return_inverse=True)
    last = dense[order - 1]  # the transform
    count = _counter(last, len(symbols))
    last = last.astype(np.uint16)
    starts = np.searchsorted(np.sort(dense), np.arange(len(symbols)))[1:, None]
    # each place's suffix with its symbol in front, and the places of the same symbol before and after it; ends have none
    by_symbol = np.argsort(last, kind="stable")
    front = np.empty(n, np.int64)
    front[by_symbol] = np.arange(n)
    alike = last[by_symbol[1:]] == last[by_symbol[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[by_symbol[1:][alike]], after[by_symbol[:-1][alike]] = by_symbol[:-1][alike], by_symbol[1:][alike]
    before[last == 0], after[last == 0] = n, -1
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    at_once = max(1, COUNTED // len(symbols))
    for _ in range(length):  # common prefixes of 0, 1, 2, ... bytes
        lows, highs = [], []
        # intervals of fewer places than symbols: place by place
        size = high - low
        few = size < len(symbols)
        size, own_low, own_high = size[few], low[few], high[few]
        at = np.arange(int(size.sum())) + np.repeat(own_low - np.cumsum(size) + size, size)
        # the intervals in front are disjoint, so their sorted bounds belong together
        left = np.sort(front[at[before[at] < np.repeat(own_low, size)]])
        right = np.sort(front[at[after[at] >= np.repeat(own_high, size)]]) + 1
        new = ~known[right]
        lows.append(left[new])
        highs.append(right[new])
        # the others: symbol by symbol
        low, high = low[~few], high[~few]
        for i in range(0, len(low), at_once):
            left, right = starts + count(low[i : i + at_once]), starts + count(high[i : i + at_once])
            new = (right > left) & ~known[right]
            lows.append(left[new])
            highs.append(right[new])
        low, high = np.concatenate(lows), np.concatenate(highs)
        if not len(low):
            break
        known[high] = True
    same = np.flatnonzero(~known[1:n]) + 1
    same = same[(rest[order[same - 1]] >= length) & (rest[order[same]] >= length)]
    found = np.zeros(n, bool)
    found[order[same - 1]] = found[order[same]] = True
    return [found[e - s : e - s + max(0, s - length + 1)] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _two(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _rows(out: list[tuple], kinds: tuple, names: list[str], size: int = 5000):
    for i in range(0, len(out), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + size], strict=True), kinds, strict=True)], names)


_I64, _I32 = pa.int64(), pa.int32()


def _all_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for key, row, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = t.encode("utf-8", "surrogatepass") if t else b""
                out += [(a, *_two(xxhash.xxh3_128_digest(data[s : e + length])), key, row, s, e, p - s) for a, s, e, p in runs_of(data, length, gram)]
            yield from _rows(out, (_I64, _I64, _I64, _I64, _I64, _I32, _I32, _I32), ["a", "c1", "c2", "doc_id", "row", "s", "e", "p"])

    return texts.mapInArrow(run, "a bigint, c1 bigint, c2 bigint, doc_id bigint, row bigint, s int, e int, p int")


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs (a, c1, c2, n, crowded and a place) with their bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for t, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                out += [(p["a"], p["c1"], p["c2"], p["n"], p["crowded"], p["doc_id"], p["row"], p["s"], p["p"], data[p["s"] : p["e"] + length]) for p in places]
            yield from _rows(out, (_I64, _I64, _I64, _I64, pa.bool_(), _I64, _I64, _I32, _I32, pa.binary()), ["a", "c1", "c2", "n", "crowded", "doc_id", "row", "s", "p", "bytes"], 2000)

    places = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("a", "c1", "c2", "n", "crowded", "doc_id", "row", "s", "e", "p")).alias("places"))  # at most a document's own runs
    places = places.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "places")
    found = texts.join(places, texts["doc_id"].eqNullSafe(places["d"]) & (texts["row"] == places["r"])).select("text", "places")
    return found.mapInArrow(run, "a bigint, c1 bigint, c2 bigint, n bigint, crowded boolean, doc_id bigint, row bigint, s int, p int, bytes binary").dropDuplicates(["a", "c1", "c2"])


def _by_transform(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, row, s, e) of windows that occur again, of runs that meet by anchor in one task."""

    def run(batches):
        held, size, anchor = [], 0, None

        def settled():
            out = []
            flags = repeated_windows([x[3] for x in held], length) if len(held) > 1 else []
            for (key, row, s, _, n), f in zip(held, flags, strict=False):
                out += [(key, row, s + i, s + j) for i, j in _spans(f)] if n == 1 else []
            held.clear()
            yield from _rows(out, (_I64, _I64, _I32, _I32), ["doc_id", "row", "s", "e"])

        for batch in batches:
            for a, key, row, s, data, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor and size >= TEXT_BYTES:
                    yield from settled()
                    size = 0
                anchor = a
                held.append((key, row, s, data, n))
                size += len(data)
        yield from settled()

    sorted_ = contexts.select("a", "doc_id", "row", "s", "bytes", "n").repartition("a").sortWithinPartitions("a")
    return sorted_.mapInArrow(run, "doc_id bigint, row bigint, s int, e int")


def _by_splitting(contexts: DataFrame, length: int) -> DataFrame:
    """The same for runs of very common anchors. Equal windows lie at equal distances from their anchors, so runs are cut
    at fixed distances: equal parts are cut alike, and parts with equal windows share the bytes that all windows of a
    cell have. Where few enough parts share these, they are transformed."""

    def cut(batches, size: int):
        for batch in batches:
            out = []
            for c1, c2, n, p, lo, hi, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = lo
                while at < hi:  # windows at to end - 1; p - at is the anchor's distance
                    cell = (p - at) // size
                    end = min(hi, p - cell * size + 1)
                    whole = data[at : end - 1 + length]
                    first, last = p - (cell + 1) * size + 1, p - cell * size  # windows of the whole cell
                    core = data[last : first + length]
                    out.append((c1, c2, n, p, at, end, *_two(xxhash.xxh3_128_digest(whole)), p - at, p - end, *_two(xxhash.xxh3_128_digest(core)), cell))
                    at = end
            yield from _rows(out, (*(_I64,) * 3, *(_I32,) * 3, _I64, _I64, _I32, _I32, _I64, _I64, _I32), ["c1", "c2", "n", "p", "lo", "hi", "w1", "w2", "far", "near", "k1", "k2", "cell"])

    schema = "c1 bigint, c2 bigint, n bigint, p int, lo int, hi int, w1 bigint, w2 bigint, far int, near int, k1 bigint, k2 bigint, cell int"
    open_ = contexts.select("c1", "c2", "n", "p", F.lit(0).alias("lo"), (F.octet_length("bytes") - length + 1).alias("hi"))
    bytes_ = contexts.select(F.col("c1").alias("c1_"), F.col("c2").alias("c2_"), "bytes")
    again, size = None, 1
    while size * SPLIT < length // 2:
        size *= SPLIT
    while size and not open_.isEmpty():
        full = open_.join(bytes_, (F.col("c1") == F.col("c1_")) & (F.col("c2") == F.col("c2_"))).select("c1", "c2", "n", "p", "lo", "hi", "bytes")
        parts = written(full.mapInArrow(lambda batches, size=size: cut(batches, size), schema), "parts")
        # equal parts go on as one, which counts as settled
        one = parts.groupBy("w1", "w2", "far", "near", "k1", "k2", "cell").agg(F.sum("n").alias("m"), F.min(F.struct("c1", "c2", "p", "lo", "hi")).alias("x"))
        one = written(one, "distinct-parts")
        wholes = one.where("m > 1").select(F.col("w1").alias("w1_"), F.col("w2").alias("w2_"), F.col("far").alias("far_"), F.col("near").alias("near_"))
        same = (F.col("w1") == F.col("w1_")) & (F.col("w2") == F.col("w2_")) & (F.col("far") == F.col("far_")) & (F.col("near") == F.col("near_"))
        hit = parts.where("n = 1").join(wholes, same, "left_semi").select("c1", "c2", "lo", "hi")
        again = hit if again is None else again.unionByName(hit)
        # parts whose cell's common bytes no other part has are settled too
        cores = one.groupBy("k1", "k2", "cell").agg(F.count("*").alias("rows"), F.min("m").alias("least")).where("rows > 1 AND least = 1")
        # written, so that Spark can split the join's hot keys here too
        cores = written(cores.select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), F.col("cell").alias("cell_"), (F.col("rows") > MOST_RUNS).alias("crowded")), "cores")
        core = (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")) & (F.col("cell") == F.col("cell_"))
        # a run's edge can leave one window of a wider cell, which equals windows inside others' parts; cells of one have no more
        live = one.where(F.lit(size > 1)).join(cores, core).select("x.c1", "x.c2", F.col("m").alias("n"), "x.p", "x.lo", "x.hi", F.xxhash64("k1", "k2", "cell").alias("a"), "crowded")
        live, size = written(live, "open"), size // SPLIT
        ready = live.where("NOT crowded").join(bytes_, (F.col("c1") == F.col("c1_")) & (F.col("c2") == F.col("c2_")))
        ready = ready.select("a", F.col("c1").alias("doc_id"), F.col("c2").alias("row"), F.col("lo").alias("s"), F.expr(f"substring(bytes, lo + 1, hi - lo + {length - 1})").alias("bytes"), "n")
        met = written(_by_transform(ready, length), "part-spans")
        again = again.unionByName(met.select(F.col("doc_id").alias("c1"), F.col("row").alias("c2"), F.col("s").alias("lo"), F.col("e").alias("hi")))
        open_ = live.where("crowded").select("c1", "c2", "n", "p", "lo", "hi")
    if again is None:
        return contexts.select("doc_id", "row", "s", F.col("s").alias("e")).where("false")
    own = contexts.where("n = 1").select(F.col("c1").alias("c1_"), F.col("c2").alias("c2_"), "doc_id", "row", F.col("s").alias("start"))
    out = again.join(own, (F.col("c1") == F.col("c1_")) & (F.col("c2") == F.col("c2_")))
    return out.select("doc_id", "row", (F.col("start") + F.col("lo")).cast("int").alias("s"), (F.col("start") + F.col("hi")).cast("int").alias("e"))


def _cleaned(texts: DataFrame, spans: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Each row of `texts` without the bytes of the windows in `spans`."""

    def run(batches):
        for batch in batches:
            out = []
            for key, t, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = t.encode("utf-8", "surrogatepass") if t else b""
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for w in sorted(windows or [], key=lambda w: (w["s"], w["e"])):
                    s, e = w["s"], w["e"] - 1 + length
                    if s > end:  # runs that touch are one
                        n += 1
                        kept.append(data[at:s])
                        removed += e - s
                        at = end = e
                    elif e > end:
                        removed += e - end
                        at = end = e
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((key, len(data), removed, n, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            yield from _rows([x[: 5 + with_text] for x in out], (_I64, _I64, _I64, _I64, pa.string(), pa.binary())[: 5 + with_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text], 1000)

    by_row = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("s", "e")).alias("windows"))  # at most a document's own
    by_row = by_row.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "windows")
    found = texts.join(by_row, texts["doc_id"].eqNullSafe(by_row["d"]) & (texts["row"] == by_row["r"]), "left").select("doc_id", "text", "windows")
    return found.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256 and, with
    `with_text`, the bytes that are left.

    A byte goes if a string of `length` bytes over it starts at another place of any row too, its own included; all is
    judged on the input. Null and empty texts have no bytes. Repeated rows are each other's repetition, and so are rows
    that share a null id. Other columns are left out; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("row"), t.alias("text"))
    runs = written(_all_runs(texts.where(F.octet_length("text") >= length), length, gram), "runs")
    # counted apart from the join, so that Spark can split the join's hot anchors
    twice = written(runs.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select(F.col("a").alias("a_")), "repeated-anchors")
    runs = written(runs.join(twice, F.col("a") == F.col("a_")).drop("a_"), "shared-runs")
    kinds = written(runs.groupBy("a", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "s", "e", "p")).alias("x")), "distinct-runs")
    anchors = kinds.groupBy("a").agg(F.count("*").alias("m"), F.max((F.col("n") == 1).cast("int")).alias("single")).where("m > 1 AND single = 1")
    anchors = written(anchors.select(F.col("a").alias("a_"), (F.col("m") > MOST_RUNS).alias("crowded")), "open-anchors")
    wanted = kinds.join(anchors, F.col("a") == F.col("a_")).select("a", "c1", "c2", "n", "crowded", "x.*")
    with small_batches(docs.sparkSession, 1000):
        contexts = written(_contexts(texts, wanted, length), "contexts")
        spans = written(_by_transform(contexts.where("NOT crowded"), length), "spans")
        more = _by_splitting(contexts.where("crowded"), length)
        whole = kinds.where("n > 1").select(F.col("a").alias("a_"), F.col("c1").alias("c1_"), F.col("c2").alias("c2_"))
        settled = runs.join(whole, (F.col("a") == F.col("a_")) & (F.col("c1") == F.col("c1_")) & (F.col("c2") == F.col("c2_")), "left_semi").select("doc_id", "row", "s", (F.col("e") + 1).alias("e"))
        spans = written(spans.unionByName(more).unionByName(settled), "spans")
    return _cleaned(texts, spans, length, with_text)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"), with_text=False)
