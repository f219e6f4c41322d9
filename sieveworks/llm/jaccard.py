"""N-gram Jaccard self-join by vertical partitioning.

A document is its set of hashed word n-grams. Documents of equal sets form one class, so that copies of any
number are one row of the join. The space of n-grams is cut into parts that are counted separately and summed:

1. First count. N-grams in the lower FIRST of the hash space are dealt to buckets; each bucket counts, for every
   class, those that some other class has too. The sums say which classes have more than 100 - percent of their
   n-grams for themselves; these link with nothing and are done. Each batch of documents sends an n-gram once.
2. Global order. The n-grams of the classes that are left are counted exactly and ordered by (classes, hash),
   those of one class alone first. Similar classes share an n-gram of their prefixes in that order.
3. Fragments. The order is cut at FRAGMENTS - 1 pivots of equal weight. A candidate pair must pass the filters
   on size and position and the bound that the sizes of its segments set; then the overlaps of its fragments
   are counted separately and summed.

Candidates are generated without listing all pairs of a large group: under every n-gram the members are first
paired with three leaders, those with the fewest n-grams of their own among them; the links found are contracted
to components. Then only members outside the largest component of their n-gram are paired, with members of
other components. No candidate pair of different components is left out, so that the components are those of
the full join.

Defined results: null text, an empty text and one without words have an empty set and link with nothing;
fewer words than n make one n-gram of the whole; rows that repeat in id and text are one class; null ids
are kept and never a component's smallest id unless alone; an empty table stays empty; other columns play
no part. N-grams are 64-bit hashes, classes and rows 128-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import as_bytes, cut, drop_cut, slices
from sieveworks.llm.components import components

FIRST = 0.35
FRAGMENTS = 8
#: N-grams of one bucket of the first count, classes whose counts are summed together; documents and bytes of a batch that sends an n-gram once.
BUCKET_GRAMS, PART_CLASSES = 2_000_000, 1_000_000
BATCH_ROWS, BATCH_BYTES = 16_384, 32 << 20


class _Words(dict):
    """Hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    """One hash of the words at the same place of all arrays, in their order."""
    h = np.full(len(words[0]), (len(words) * 0x9E3779B97F4A7C15) % 2**64, np.uint64)
    for w in words:
        h ^= w
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


class Shingler:
    """Sets of 64-bit hashes of the word n-grams of texts, one numpy pass over a batch of documents."""

    def __init__(self, n: int, most: int = 400_000):
        self.n, self._most, self._known = n, most, _Words()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct n-grams of each text in order of hash."""
        cuts = [t.lower().split() for t in texts]  # bytes: lower-cases A-Z, cuts at U+0020 and U+0009 to U+000D
        if len(self._known) > self._most:
            self._known = _Words()
        size = [len(c) for c in cuts]
        words = np.fromiter(map(self._known.__getitem__, chain.from_iterable(cuts)), np.uint64, sum(size))
        n = self.n
        every = _mixed([words[j : len(words) - n + 1 + j] for j in range(n)]) if len(words) >= n else words[:0]
        out, at = [], 0
        for k in size:
            if k >= n:
                h = np.sort(every[at : at + k - n + 1])
                out.append(h[np.r_[True, h[1:] != h[:-1]]])
            else:
                out.append(_mixed([words[at + j : at + j + 1] for j in range(k)]) if k else words[:0])
            at += k
        return out


def _signature(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _rid() -> Column:
    """A name of 128 bits for a row's id and text."""
    text = F.when(F.col("text").isNull(), F.lit("n")).otherwise(F.concat(F.lit("t"), "text"))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), text)))


def _limit() -> np.uint64:
    return np.uint64(min(2**64 - 1, int(FIRST * 2**64)))


def _sizes(n: int):
    """doc_id, rid, size of the set, how much of it lies in the first part, signature, its first half as a number."""
    limit = _limit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(n)
        for batch in slices(batches, 1000, 4 << 20):
            sets = make.sets(as_bytes(batch.column(0)))
            sig = [_signature(s) for s in sets]
            size = np.array([len(s) for s in sets], np.int64)
            low = np.array([np.searchsorted(s, limit) for s in sets], np.int64)
            key = pa.array([None if s is None else int.from_bytes(s[:8], "little", signed=True) for s in sig], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(size), pa.array(low), pa.array(sig, pa.binary()), key], ["doc_id", "rid", "n", "low", "sig", "key"])

    return run


_ENTRIES = "bucket int, grams binary, keys binary, own binary, counts binary"


def _entries(n: int, buckets: int):
    """The first part's n-grams of a batch by bucket, each once with its class (0: several classes of the batch).

    own and counts, on one row of the batch: how many n-grams each class shares inside the batch.
    """
    limit = _limit()
    width = max(1, -(-int(limit) // buckets))

    def rows(grams: list[np.ndarray], keys: list[int]) -> Iterator[tuple]:
        size = [len(g) for g in grams]
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        cls = np.repeat(np.arange(len(size)), size)
        order = np.argsort(g)
        g, cls = g[order], cls[order]
        new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        many = np.diff(np.r_[at, len(g)]) > 1
        local = np.bincount(cls[np.repeat(many, np.diff(np.r_[at, len(g)]))], minlength=len(size))
        name = np.array(keys, np.int64)
        key = np.where(many, 0, name[cls[at]]) if len(at) else np.zeros(0, np.int64)
        g = g[at]
        bucket = (g // np.uint64(width)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(g) else np.zeros(0, np.int64)
        sums = (name[local > 0].tobytes(), local[local > 0].astype(np.int64).tobytes())
        for i, (a, b) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(g)])):
            yield (int(bucket[a]), g[a:b].tobytes(), key[a:b].tobytes(), *(sums if i == int(g[0]) % len(begin) else (None, None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(n)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        for big in slices(batches, BATCH_ROWS, BATCH_BYTES):
            grams, known = [], {}
            for batch in slices([big], 1000, 4 << 20):
                for s in make.sets(as_bytes(batch.column(0))):
                    sig = _signature(s)
                    if sig is not None and sig not in known:
                        known[sig] = int.from_bytes(sig[:8], "little", signed=True) or 1
                        grams.append(s[: np.searchsorted(s, limit)])
            found = list(rows(grams, list(known.values())))
            for i in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found[i : i + 64]), kinds)], ["bucket", "grams", "keys", "own", "counts"])

    return run


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist() if x)])


def _summed(names: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, where = np.unique(names, return_inverse=True)
    return names, np.bincount(where, times, len(names)).astype(np.int64)


def _shared_in_bucket(parts: int):
    """How many n-grams of the bucket each class shares with another (too high for copies of one class, never too low).

    One row for each part of the classes, which are dealt by their key: part, keys, counts.
    """

    def run(rows: pa.Table) -> pa.Table:
        g, key = _joined(rows["grams"], np.uint64), _joined(rows["keys"], np.int64)
        order = np.argsort(g)
        g, key = g[order], key[order]
        at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        least, most = (f.reduceat(key, at) if len(g) else key for f in (np.minimum, np.maximum))
        several = (least != most) | (least == 0)
        hit = key[np.repeat(several, np.diff(np.r_[at, len(g)]))]
        hit = hit[hit != 0]
        names, times = _summed(np.r_[hit, _joined(rows["own"], np.int64)], np.r_[np.ones(len(hit), np.int64), _joined(rows["counts"], np.int64)])
        part = names % parts
        order = np.argsort(part, kind="stable")
        names, times, part = names[order], times[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        blob = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
        return pa.table([pa.array(np.arange(parts, dtype=np.int32)), blob(names), blob(times)], ["part", "keys", "counts"]).filter(pa.array(np.diff(cuts) > 0))

    return run


def _shared_in_all(rows: pa.Table) -> pa.Table:
    names, times = _summed(_joined(rows["keys"], np.int64), _joined(rows["counts"], np.int64))
    return pa.table([pa.array(names), pa.array(times)], ["counted_key", "shared"])


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(n)
        for batch in slices(batches, 1000, 4 << 20):
            sets = make.sets(as_bytes(batch.column(0)))
            size = np.array([len(s) for s in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(size), lists], ["sig", "n", "grams"])

    return run


def similar(overlap, n_a, n_b, percent: int = 80):
    """Whether 100 * intersection >= percent * union."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _plausible(percent: int) -> str:
    """Size and position filter of a pair under one shared n-gram; exact for its first shared one."""
    need = f"{percent} * (n_a + n_b)"
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {100 + percent} * least(n_a - pos_a, n_b - pos_b) >= {need}"


def _survivors(source: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """rid, sig of one row of every class whose n-grams may be shared to `percent`, by the first count."""
    spark = source.sparkSession
    low = sets.agg(F.sum("low")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-low // BUCKET_GRAMS))
    entries = source.select("text").mapInArrow(_entries(n, buckets), _ENTRIES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() // PART_CLASSES))
    counted = entries.groupBy("bucket").applyInArrow(_shared_in_bucket(parts), "part int, keys binary, counts binary")
    counted = counted.groupBy("part").applyInArrow(lambda rows: _shared_in_all(rows), "counted_key long, shared long")
    classes = sets.where("sig IS NOT NULL").groupBy("sig", "n", "low", "key").agg(F.min("rid").alias("rid"))
    joined = classes.join(counted, F.when(F.col("key") == 0, F.lit(1)).otherwise(F.col("key")) == F.col("counted_key"), "left")
    return joined.where(100 * (F.col("n") - F.col("low") + F.coalesce("shared", F.lit(0))) >= percent * F.col("n")).select("rid", "sig")


def _ordered(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """sig, n, alone (n-grams that no other class has), o: the others in the global order as (c, gram); classes that may link."""
    made = cut(texts.mapInArrow(_grams(n), "sig binary, n long, grams array<long>").dropDuplicates(["sig"]), "grams")
    rows = made.select("sig", "n", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("c")).where("c > 1")
    order = F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("o")  # bounded by one document's set
    held = rows.join(counts, "gram").groupBy("sig", "n").agg(order)
    done = cut(held.where(100 * F.size("o") >= percent * F.col("n")).select("sig", "n", (F.col("n") - F.size("o")).alias("alone"), "o"), "ordered")
    drop_cut(made)
    return done


def _segments(pivots: np.ndarray):
    """The classes' n-grams cut at places of the order: sig, sizes of the segments, the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            o = batch.column(1)
            flat = o.flatten()
            gram = flat.field("gram").to_numpy()
            place = flat.field("c").to_numpy().astype(np.int64) * 4096 + (gram >> 52) + 2048
            row = np.repeat(np.arange(batch.num_rows), np.diff(o.offsets.to_numpy()))
            sizes = np.bincount(row * FRAGMENTS + np.searchsorted(pivots, place, "right"), minlength=batch.num_rows * FRAGMENTS)
            ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            lists = pa.ListArray.from_arrays(ends(sizes), pa.array(gram))
            each = np.full(batch.num_rows, FRAGMENTS)
            columns = [batch.column(0), pa.ListArray.from_arrays(ends(each), pa.array(sizes.astype(np.int32))), pa.ListArray.from_arrays(ends(each), lists)]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "sizes", "segments"])

    return run


def _fragments(ordered: DataFrame) -> DataFrame:
    """Segments of the classes, cut at pivots of the global order: sig, sizes, segments. The order is by c, then gram."""
    place = F.col("x.c").cast("long") * 4096 + F.shiftright("x.gram", 52) + 2048
    share = [i / FRAGMENTS for i in range(1, FRAGMENTS)]
    pivots = ordered.select(F.explode("o").alias("x")).agg(F.percentile_approx(place, share, 1000)).first()[0] or []
    made = ordered.select("sig", "o").mapInArrow(_segments(np.array(pivots, np.int64)), "sig binary, sizes array<int>, segments array<array<long>>")
    return cut(made, "fragments")


def _verify(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that are similar: overlaps are counted per fragment and summed, where the segments' sizes allow as much."""
    a, b = (fragments.select(F.col("sig").alias(k), F.col("sizes").alias(f"sizes_{k}")) for k in "ab")
    most = F.aggregate(F.zip_with("sizes_a", "sizes_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = pairs.distinct().join(a, "a").join(b, "b").where(similar(most, F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")
    left, right = (fragments.select(F.col("sig").alias(k), F.posexplode("segments").alias("frag", f"grams_{k}")) for k in "ab")
    part = F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("part")
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "n_a", "n_b", part)
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap")).where(similar(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _with_leaders(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of every member of an n-gram with its leaders."""
    one = F.struct("sig", "n", "pos")
    by = lambda *first, seed: F.min_by(one, F.struct(*first, F.xxhash64(F.lit(seed), "sig")))
    leaders = F.array_distinct(F.array(by("alone", seed=1), by(F.floor(F.col("alone") / 4), seed=2), by(seed=3)))
    lists = members.groupBy("gram", "k").agg(F.count(F.lit(1)).alias("held"), leaders.alias("l")).where("held > 1").select("gram", "k", F.explode("l").alias("l"))
    pairs = members.join(lists, ["gram", "k"]).where("sig <> l.sig").select(
        "sig", F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("l.sig").alias("leader"), F.col("l.n").alias("n_b"), F.col("l.pos").alias("pos_b")
    )
    swap = F.col("sig") > F.col("leader")
    one, two = F.when(swap, F.col("leader")).otherwise(F.col("sig")), F.when(swap, F.col("sig")).otherwise(F.col("leader"))
    n_one, n_two = F.when(swap, F.col("n_b")).otherwise(F.col("n_a")), F.when(swap, F.col("n_a")).otherwise(F.col("n_b"))
    return pairs.where(_plausible(percent)).select(one.alias("a"), two.alias("b"), n_one.alias("n_a"), n_two.alias("n_b"))


def _between_roots(members: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of members of an n-gram that belong to different components."""
    if roots is None:
        placed = members.withColumn("root", F.col("sig"))
    else:
        placed = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    placed = cut(placed, "placed")
    by_root = placed.groupBy("gram", "k", "root").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least"))
    lists = by_root.groupBy("gram", "k").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", "held").alias("largest"), F.min("least").alias("least")).where("roots > 1")
    # a member whose n-gram comes too late for the smallest partner in the list meets nobody there
    still = placed.join(lists, ["gram", "k"]).where(f"{100 + percent} * (n - pos) >= {percent} * (n + least)")
    a, b = (still.select("gram", "k", *[F.col(c).alias(f"{c}_{s}") for c in ("sig", "n", "pos", "root", "c", "largest")]) for s in "ab")
    minor = a.where("root_a <> largest_a").drop("largest_a")
    # two of the lower class of k meet under their own k; two outside the largest component meet once
    meet = "root_a <> root_b AND (root_b = largest_b OR sig_a < sig_b) AND (c_a = k OR c_b = k)"
    pairs = minor.join(b, ["gram", "k"]).where(meet).where(_plausible(percent))
    swap = F.col("sig_a") > F.col("sig_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("sig_a", "sig_b").alias("a"), pick("sig_b", "sig_a").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))


def _named(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, rid, n, root for every row of docs; root is null where the set is empty."""
    source = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).withColumn("rid", _rid()).select("text", "doc_id", "rid")
    sets = cut(source.mapInArrow(_sizes(n), "doc_id long, rid binary, n long, low long, sig binary, key long"), "sets")
    chosen = cut(_survivors(source, sets, n, percent), "survivors")
    ordered = _ordered(source.select("rid", "text").join(chosen, "rid").select("text", "sig"), n, percent)
    fragments = _fragments(ordered)
    prefix = F.expr(f"cast(n - ceil({percent} * n / 100) + 1 - alone as int)")
    # classes of sizes within a factor of 1 / 0.8 meet in one of two size classes
    size_class = F.floor(F.log("n") / np.log(100 / percent) + 1e-9).cast("int")
    rows = ordered.select("sig", "n", "alone", F.posexplode(F.slice("o", F.lit(1), prefix)).alias("i", "x"))
    rows = rows.select("sig", "n", "alone", (F.col("alone") + F.col("i")).alias("pos"), F.col("x.gram").alias("gram"), size_class.alias("c"))
    members = cut(rows.withColumn("k", F.explode(F.array("c", F.col("c") + 1))), "members")
    links = cut(_verify(_with_leaders(members, percent), fragments, percent), "links")
    roots = components(links)
    rest = cut(_verify(_between_roots(members, roots, percent), fragments, percent), "rest")
    if not rest.isEmpty():
        roots = components(links.unionByName(rest))
    named = sets.select("doc_id", "rid", "n", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    named = cut(named.select("doc_id", "rid", "n", F.coalesce("root", "sig").alias("root")), "named")
    drop_cut(sets, chosen, ordered, fragments, members, links, rest, roots)
    return named


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, rid, n_shingles, component_id: one row per row of docs (doc_id long, text string)."""
    named = _named(docs, n, percent)
    smallest = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(smallest, "root", "left")
    return joined.select("doc_id", "rid", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of every component, that of the smallest id (null only where all are), and the rows whose set is empty."""
    named = _named(docs, n, percent).where("root IS NOT NULL")
    first = named.groupBy("root").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("rid"))
    gone = named.select("rid").distinct().join(first.select("rid"), "rid", "left_anti").withColumn("twice", F.lit(False))
    twice = named.groupBy("rid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("rid", F.lit(True).alias("twice")).join(first.select("rid"), "rid", "left_semi")
    marked = gone.unionByName(twice)
    own = docs.select(F.struct("*").alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id")).select("row", _rid().alias("rid"))
    rows = own.join(marked, "rid", "left").where("twice IS NULL OR twice")
    repeated = rows.where("twice").groupBy("rid").agg(F.first("row").alias("row"))
    return rows.where("twice IS NULL").select("row.*").unionByName(repeated.select("row.*"))
