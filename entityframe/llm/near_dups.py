"""Near-duplicate groups of documents by SetSketch registers over word shingles.

A register holds the truncated logarithm of the least of exponential values over a document's shingles, so equal
registers are as likely as the sets are similar, and sketches merge by the larger register. Documents with equal
shingle sets form a class; classes that agree in a band of registers become candidates. A candidate pair is estimated
jointly from its registers by likelihood, far estimates go, and the rest are confirmed on the full sets.

Within a bucket not all pairs are tried: members first meet the most common pivot, then those that stay outside the
bucket's most common component meet the members of other components, block by block inside tasks; large buckets try
some more pivots before. So large groups of copies cost about as many pairs as they have members, and no link between
different components is left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, written
from .graph import components
from .topk_search import small_batches

#: Registers of a band, bands; at a similarity of 0.8 a pair misses all bands with a probability of 3e-6.
BAND_ROWS, BANDS = 4, 24
#: SetSketch base, rate and largest register; the least value of 32 bits fits the register range.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
_U64 = np.uint64
_M = BAND_ROWS * BANDS
_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 1 << 63, _M, dtype=np.uint64) * _U64(2) + _U64(1)
_ADD = _rng.integers(0, 1 << 63, _M, dtype=np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHAR_BASE = 0xD1342543DE82EF95
_pow = [np.ones(1, _U64), np.ones(1, _U64)]
#: Members of a bucket that are compared at once: so many of those outside its most common component, and of all.
BLOCK_OUTSIDE, BLOCK_ALL = 64, 256
#: Sets of texts that a task remembers while it confirms pairs.
REMEMBERED = 64
#: Pivots that a member of buckets with more than BLOCK_OUTSIDE members tries.
PIVOTS = 8
#: Vertices of the link graph are classes, known by their least id and so many values of their fingerprint.
FINGERPRINTS = 1 << 56


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, from prefix sums of a polynomial over the bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    n = len(data)
    if len(_pow[0]) < n:
        for i, b in enumerate((_CHAR_BASE, pow(_CHAR_BASE, -1, 1 << 64))):
            p = np.full(2 * n, b, _U64)
            p[0] = 1
            _pow[i] = np.multiply.accumulate(p)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(n + 1, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * _pow[0][:n], out=total[1:])
    return _mix((total[last] - total[first]) * _pow[1][first] + (last - first).astype(_U64))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the `words`-word shingles; of the whole sequence if it is shorter; none without words."""
    w = _word_hashes(text) if text else np.empty(0, _U64)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, _U64)
    for i in range(k):
        h = _mix(h * _U64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes."""
    low = np.full(_M, (1 << 32) - 1, _U64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[i : i + 2048, None] * _MUL + _ADD) >> _U64(32)).min(0))
    exponential = -np.log1p(-(low.astype(float) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarities of pairs of sets of known sizes from their registers (rows of ra and rb)."""
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def sketched(docs: DataFrame, words: int, id_col: str, text: str) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, the set's fingerprint (f1, f2; null if empty), band keys and registers."""

    def run(batches):
        for batch in batches:
            out = []
            for key, row, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingle_hashes(t, words)
                if not len(h):
                    out.append((key, row, 0, None, None, None, None))
                    continue
                r = registers(h)
                bands = np.arange(BANDS, dtype=_U64) + _U64(1)
                for i in range(BAND_ROWS):
                    bands = _mix(bands * _U64(0x9E3779B97F4A7C15) + r.reshape(BANDS, BAND_ROWS)[:, i])
                m = _mix(h)
                out.append((key, row, len(h), int(m.sum(dtype=_U64).astype(np.int64)), int(np.bitwise_xor.reduce(m * _U64(0xD6E8FEB86659FD93)).astype(np.int64)), bands.astype(np.int64), r.tobytes()))
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out[i : i + 2000], strict=True), (*(pa.int64(),) * 5, pa.list_(pa.int64()), pa.binary()), strict=True)],
                    ["doc_id", "row", "n_shingles", "f1", "f2", "bands", "regs"])

    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text), F.col(text)).mapInArrow(run, "doc_id bigint, row bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, regs binary")


def _vertex(rep: str, f1: str):
    """One number for a class, ordered by its least id first."""
    return F.expr(f"cast({rep} AS decimal(20, 0)) * {FINGERPRINTS}BD + cast(shiftrightunsigned({f1}, 8) AS decimal(17, 0))").cast("decimal(38,0)")


def _least_id(vertex: str):
    return F.expr(f"cast(({vertex} - pmod({vertex}, {FINGERPRINTS}BD)) / {FINGERPRINTS}BD AS bigint)")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """vertex, n, registers and text of the wanted classes (vertex, rep, row, n, regs). Texts move in place of their sets,
    which are several times larger and don't compress."""
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__row"), F.col(text).alias("__text"))
    found = texts.join(wanted, (F.col("__id") == F.col("rep")) & (F.col("__row") == F.col("row")))
    return found.select("vertex", "n", "regs", F.col("__text").alias("text")).dropDuplicates(["vertex"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Hashes that two sets share; both are sorted and without repetition."""
    return len(np.intersect1d(a, b, assume_unique=True))


def _spread(percent: int) -> float:
    """Six standard deviations of an estimate at the threshold."""
    return 6 * np.sqrt(percent / 100 * (1 - percent / 100) / _M)


def _links(pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked ones of the pairs of vertices (a, b): 100 * intersection >= percent * union of the full sets."""
    spread = _spread(percent)

    def run(batches):
        hashes = lru_cache(REMEMBERED)(lambda t: shingle_hashes(t, words))
        for batch in batches:
            rows = batch.to_pylist()
            regs = [np.frombuffer(b"".join(r[c] for r in rows), "<u2").reshape(-1, _M) for c in ("ra", "rb")] if rows else [np.zeros((0, _M))] * 2
            guess = estimate(*regs, np.array([r["na"] for r in rows], float), np.array([r["nb"] for r in rows], float))
            linked = []
            for r, j in zip(rows, guess, strict=True):
                both = _shared(hashes(r["ta"]), hashes(r["tb"])) if j >= percent / 100 - spread else 0
                linked.append(100 * both >= percent * (r["na"] + r["nb"] - both))
            yield batch.select(["a", "b"]).rename_columns(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    def side(s: str) -> DataFrame:
        return sets.select(F.col("vertex").alias(f"{s}_vertex"), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"), F.col("text").alias(f"t{s}"))

    full = pairs.join(side("a"), F.col("a") == F.col("a_vertex")).join(side("b"), F.col("b") == F.col("b_vertex"))
    with small_batches(pairs.sparkSession, 128):
        return written(full.select("a", "b", "na", "nb", "ra", "rb", "ta", "tb").mapInArrow(run, "u decimal(38,0), v decimal(38,0)"), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (least id reachable over links), kept (its own component_id),
    and two columns that tell rows and components apart where ids repeat: row (a hash of the text) and component.

    Null, empty and blank texts have no shingles and are linked with nothing: they are components of their own, with
    null in `component`. Rows with a null id take no part; their component_id is null and they are kept. Rows that
    repeat an id are linked by their own texts and share a result if these have one set. Other columns are left out;
    an empty table gives no rows.
    """
    rows = written(sketched(docs, words, id_col, text), "sketches")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "row")).alias("x"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
    classes = classes.select("f1", "f2", F.col("x.doc_id").alias("rep"), "x.row", "n", "bands", "regs")
    classes = written(classes.withColumn("vertex", _vertex("rep", "f1")), "classes")
    banded = classes.select("vertex", "n", F.posexplode("bands").alias("band", "key"))
    pivots = banded.withColumn("p", F.xxhash64("vertex")).groupBy("key").agg(F.min("p").alias("p"), F.min_by("vertex", "p").alias("pivot"), F.count("*").alias("size"))
    pivots = pivots.where("size > 1").select(F.col("key").alias("k"), "p", "pivot", "size")
    members = written(banded.join(pivots, F.col("key") == F.col("k")).drop("k"), "members")
    in_buckets = members.select(F.col("vertex").alias("in_bucket")).distinct()
    wanted = classes.join(in_buckets, F.col("vertex") == F.col("in_bucket"), "left_semi").select("vertex", "rep", "row", "n", "regs")
    sets = written(_sets(docs, wanted, id_col, text), "sets")

    # the most common pivot of each member
    first = members.where("vertex <> pivot").groupBy(F.col("vertex").alias("a")).agg(F.min_by("pivot", "p").alias("b"))
    links = _links(first, sets, words, percent)
    found = components(links, "pivot-components")

    # large buckets that still hold several components: each member against some pivots more, as many in all its buckets
    marked = _open_members(members, found)
    large = marked.where(F.col("size") > BLOCK_OUTSIDE).withColumns({"p": F.xxhash64("vertex", F.lit(6)), "slot": F.pmod(F.xxhash64("vertex", F.lit(5)), F.lit(PIVOTS))})
    slots = [(i, F.when(F.col("slot") == i, F.col("p"))) for i in range(PIVOTS)]
    chosen = large.groupBy(F.col("key").alias("k")).agg(*[x for i, own in slots for x in (F.min(own).alias(f"p{i}"), F.min_by("vertex", own).alias(f"v{i}"), F.min_by("c", own).alias(f"c{i}"))], F.first("size").alias("of"))
    tries = _with_buckets(large, chosen).groupBy("vertex", "c").agg(*[F.min_by(F.struct(F.col(f"v{i}").alias("b"), F.col(f"c{i}").alias("bc")), f"p{i}").alias(f"x{i}") for i in range(PIVOTS)])
    pairs = tries.select(F.col("vertex").alias("a"), "c", F.explode(F.array(*[f"x{i}" for i in range(PIVOTS)])).alias("x")).where("x.b IS NOT NULL AND c <> x.bc").select("a", "x.b").distinct()
    more = _links(pairs, sets, words, percent)
    if not more.isEmpty():
        found = components(found.select(F.col("v").alias("u"), F.col("component").alias("v")).unionByName(more), "large-components")
        marked = _open_members(members, found)

    # members outside the pivot's component against those of other components
    more = _links_in_blocks(marked, sets, words, percent)
    if not more.isEmpty():
        found = components(found.select(F.col("v").alias("u"), F.col("component").alias("v")).unionByName(more))

    known = classes.select("f1", "f2", "vertex").join(found, F.col("vertex") == F.col("v"), "left").select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.coalesce("component", "vertex").alias("component"))
    out = rows.join(known, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce(_least_id("component"), "doc_id").alias("component_id"), "row", "component")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row", "component")


def _open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component c and whether it isn't the bucket's most
    common one; `size` and `outs` count the bucket's members and those outside its most common component."""
    at = found.select(F.col("v").alias("c_v"), "component")
    marked = members.join(at, F.col("vertex") == F.col("c_v"), "left").select("key", "band", "vertex", "size", F.coalesce("component", "vertex").alias("c"))
    marked = written(marked, "marked")
    most = marked.groupBy("key", "c").agg(F.count("*").alias("n"), F.first("size").alias("of")).groupBy(F.col("key").alias("k")).agg(F.max_by("c", "n").alias("main"), F.max("of").alias("of"), F.max("n").alias("n"))
    most = most.where("n < of").select("k", "main", "of", (F.col("of") - F.col("n")).alias("outs"))
    return written(_with_buckets(marked, most).select("key", "band", "vertex", "c", (F.col("c") != F.col("main")).alias("outside"), "size", "outs"), "open")


def _with_buckets(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Members (key, vertex, size) with the columns of their bucket (k, its size `of`, others). A bucket's members meet it
    in parts of bounded size, so a large one is spread over tasks."""
    parts = lambda size: F.ceil(F.col(size) / BLOCK_ALL).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("vertex", F.lit(7)), parts("size")).cast("int"))
    each = buckets.withColumn("to_part", F.explode(F.sequence(F.lit(0), parts("of") - 1)))
    return dealt.join(each, (F.col("key") == F.col("k")) & (F.col("part") == F.col("to_part"))).drop("k", "part", "to_part", "of")


def _links_in_blocks(marked: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between members outside their bucket's most common component and members of other components.

    Both are dealt into blocks of bounded size whose registers and texts meet block by block, so a large bucket is spread
    over tasks and its pairs never become rows. A pair that shares several bands is compared in the first of them: in
    a bucket without outside members all have one component.
    """
    own = sets.select(F.col("vertex").alias("own"), "n", "regs", "text")
    full = marked.join(own, F.col("vertex") == F.col("own")).drop("own")
    member = F.struct("vertex", "c", "n", "regs", "text")

    def blocks(rows: DataFrame, total: str, size: int, name: str) -> DataFrame:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("vertex", F.lit(3)), F.ceil(F.col(total) / size)).cast("int"))
        return dealt.groupBy("key", "band", "block", "size").agg(F.collect_list(member).alias(name))

    outside = blocks(full.where("outside"), "outs", BLOCK_OUTSIDE, "some").select("key", "band", "some", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BLOCK_ALL) - 1).cast("int"))).alias("to"))
    every = blocks(full, "size", BLOCK_ALL, "all").select(F.col("key").alias("k"), F.col("band").alias("of"), F.col("block").alias("at"), "all")
    spread = _spread(percent)

    def compared(band: int, some: list[dict], others: list[dict]):
        ra, rb = (np.frombuffer(b"".join(x["regs"] for x in side), "<u2").reshape(-1, _M) for side in (some, others))
        na, nb = (np.array([x["n"] for x in side], float) for side in (some, others))
        parent: dict = {}
        known: dict = {}

        def root(c):
            while (p := parent.setdefault(c, c)) != c:
                c = p
            return c

        def hashes(x: dict) -> np.ndarray:
            if x["vertex"] not in known:
                known[x["vertex"]] = shingle_hashes(x["text"], words)
            return known[x["vertex"]]

        todo: list[tuple[np.ndarray, np.ndarray]] = []
        cut = band * BAND_ROWS
        for i, x in enumerate(some):
            fits = (rb[:, cut : cut + BAND_ROWS] == ra[i, cut : cut + BAND_ROWS]).all(1) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i]))
            at = np.array([j for j in np.flatnonzero(fits).tolist() if others[j]["c"] != x["c"]], int)
            at = at[(rb[at, :cut] == ra[i, :cut]).reshape(len(at), band, BAND_ROWS).all(2).sum(1) == 0]
            todo.append((np.full(len(at), i), at))
        i, j = (np.concatenate(x) for x in zip(*todo, strict=True))
        guess = estimate(ra[i], rb[j], na[i], nb[j]) if len(i) else np.empty(0)
        for k in np.argsort(-guess):
            x, y = some[i[k]], others[j[k]]
            if guess[k] < percent / 100 - spread:
                return
            a, b = root(x["c"]), root(y["c"])
            if a == b:
                continue  # one link between two components is enough
            both = _shared(hashes(x), hashes(y))
            if 100 * both >= percent * (x["n"] + y["n"] - both):
                parent[a] = b
                yield x["vertex"], y["vertex"]

    def run(batches):
        for batch in batches:
            out = [link for band, some, others in zip(*(c.to_pylist() for c in batch.columns), strict=True) for link in compared(band, some, others)]
            yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in out], pa.decimal128(38, 0)) for side in (0, 1)], ["u", "v"])

    met = outside.join(every, (F.col("key") == F.col("k")) & (F.col("band") == F.col("of")) & (F.col("to") == F.col("at"))).select("band", "some", "all")
    with small_batches(marked.sparkSession, 8):
        return written(met.mapInArrow(run, "u decimal(38,0), v decimal(38,0)"), "block-links")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2).drop("row", "component")


OP3_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g
  FROM t
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT p.v, r.c FROM r JOIN p ON p.u = r.doc_id
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
