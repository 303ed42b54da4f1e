"""Records that repeat another one's text with small edits (problem 4).

1. Every text becomes its set of distinct folded words; equal sets are one class.
2. Every class, of any size, gets a SuperMinHash signature of `SLOTS` slots. It is taken over
   the class's rarer words, since the words of a template, which thousands of texts share,
   can't tell texts apart; a class without rarer words has it over all its words.
3. Bands of `BAND` slots: the winners of a band, in any order and in any band, are a bucket's
   key. Classes that share a key are candidates.
4. A signature can miss a pair. The recall is completed by single words as further buckets:
   with the words in order of rarity, two sets that reach the threshold share one of their
   first words (the prefix, whose length follows from size and threshold). Words of the
   prefix that didn't win a band of their own become keys beside the bands.
5. Keys are counted before any bucket is made. A bucket with too many pairs is divided, not
   cut: its classes get longer keys with a second shared word, those a third one, and so on;
   each further word has to lie in a prefix that is one word longer, so no pair is lost.
   Where all words that a pair must share are used up, the bucket is compared in blocks.
   `SPLIT` says when a bucket is divided; it doesn't change the result.
6. Pairs of a bucket pass two exact bounds (sizes, and words missing by 64-bit marks), are
   drawn together, and are verified on the words themselves.
7. Verified links are grouped by connected components; links between rows come from the
   links of their classes and from classes of several rows.

Classes are told apart by a 128-bit digest and then numbered; hashes of words only choose buckets.

Defined cases: null texts and texts without words are in no class and no link; texts with
fewer than `least` distinct words are left out where a field asks for that; exact copies
are links without being compared; empty tables give empty results; further columns are
not read; texts of any length enter whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brujula.functions.text import words
from brujula.llm.sketches import frequent_words, mixed, super_min_hash, word_hash
from brujula.operators.components import components
from brujula.session import cut, spread

SLOTS, BAND = 32, 2
SPLIT = 256  # a bucket with more than SPLIT x SPLIT pairs is divided
KEYS = "k bigint, c bigint, n int, marcas bigint, corta boolean, p int"


@dataclass(frozen=True)
class Field:
    name: str
    least: int = 1


def word_sets(df: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """key, campo, palabras (sorted distinct words) of each text."""

    def run(batches):
        for b in batches:
            keys = b.column(key)
            for i, f in enumerate(fields):
                sets = [sorted(set(words(t))) if t else [] for t in b.column(f.name).to_pylist()]
                take = pa.array([len(s) >= max(1, f.least) for s in sets], type=pa.bool_())
                text = pa.array([" ".join(s) for s in sets], type=pa.string()).filter(take)
                own = keys.filter(take)
                yield pa.RecordBatch.from_arrays([own, pa.array([i] * len(own), type=pa.int8()), text], names=[key, "campo", "palabras"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, *[f.name for f in fields]), key).mapInArrow(run, f"`{key}` {kind}, campo tinyint, palabras string")


def _fewest(n: np.ndarray, part: float) -> np.ndarray:
    return np.ceil(part * n - 1e-9).astype(np.int64)


class Sets:
    """The word sets of a batch, flat, every set in order of rarity (frequent words last, ties by hash and word)."""

    def __init__(self, palabras: pa.Array, rank: dict[str, int], threshold: float):
        lists = pc.split_pattern(palabras, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        known = flat.dictionary.to_pylist()
        h = np.fromiter((word_hash(w) for w in known), dtype=np.uint32, count=len(known))
        r = np.fromiter((rank.get(w, -1) + 1 for w in known), dtype=np.int32, count=len(known))
        code = flat.indices.to_numpy(zero_copy_only=False)
        self.offsets = offsets - offsets[0]
        self.n = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((h[code], r[code], self.owner))
        self.h, self.rank = h[code][order], r[code][order]
        self.at = np.arange(len(code)) - self.offsets[self.owner]
        # words that a set must share with a partner of any size, and with one that isn't smaller
        self.shared, self.shared_short = _fewest(self.n, threshold), _fewest(self.n, 2 * threshold / (1 + threshold))

    def marks(self) -> np.ndarray:
        """64 bits of each set, one set per word: what one set's words mark and the other's don't is missing there."""
        bit = np.uint64(1) << (mixed(self.h.astype(np.uint64)) & np.uint64(63))
        return np.bitwise_or.reduceat(bit, self.offsets[:-1]) if len(self.n) else np.zeros(0, dtype=np.uint64)

    def signature(self) -> np.ndarray:
        """Winners of the slots of each set's SuperMinHash signature."""
        rarer = self.rank == 0
        own = rarer | ~np.logical_or.reduceat(rarer, self.offsets[:-1])[self.owner]
        offsets = np.append(0, np.cumsum(np.bincount(self.owner[own], minlength=len(self.n))))
        return super_min_hash(self.h[own], offsets, SLOTS) & np.uint64(0xFFFFFFFF)


def _single(h: np.ndarray, campo: np.ndarray) -> np.ndarray:
    return mixed(h.astype(np.uint64) | (campo << np.uint64(33)))


def _longer(k: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(k ^ mixed(h.astype(np.uint64) | np.uint64(1 << 62)))


def _band_keys(sets: Sets, campo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the distinct bands; a band that one word wins whole has that word's own key."""
    s = np.sort(sets.signature().reshape(len(sets.n), SLOTS // BAND, BAND), axis=2)
    k = _single(s[:, :, 0], campo[:, None])
    for i in range(1, BAND):
        k = np.where(s[:, :, i] == s[:, :, i - 1], k, _longer(k, s[:, :, i]))
    k = np.sort(k, axis=1)
    new = np.ones(k.shape, dtype=bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    return np.nonzero(new)[0], k[new]


def bucket_keys(classes: DataFrame, common: list[str], threshold: float, bands: bool = True, prefix: bool = True) -> DataFrame:
    """KEYS: k (bucket), c (class), n (its words), marcas, corta (may be the smaller of a pair here), p (the key's
    place in the class's order, -1 for a key of bands only)."""

    def run(batches):
        rank = {w: i for i, w in enumerate(reversed(common))}
        for b in batches:
            if not b.num_rows:
                continue
            sets = Sets(b.column("palabras"), rank, threshold)
            campo = b.column("campo").to_numpy(zero_copy_only=False).astype(np.uint64)
            row, k, p = [], [], []
            if prefix:
                first = np.flatnonzero(sets.at <= (sets.n - sets.shared)[sets.owner])
                own = sets.owner[first]
                row, k, p = [own], [_single(sets.h[first], campo[own])], [sets.at[first]]
            if bands:
                own, keys = _band_keys(sets, campo)
                row, k, p = [*row, own], [*k, keys], [*p, np.full(len(own), -1)]
            row, k, p = np.concatenate(row), np.concatenate(k), np.concatenate(p)
            short = (p < 0) | (p <= (sets.n - sets.shared_short)[row])
            order = np.lexsort((-p, k, row))
            row, k, p, short = row[order], k[order], p[order], short[order]
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1])))
            yield _key_batch(k[starts], b.column("c"), row[starts], sets, np.logical_or.reduceat(short, starts), p[starts])

    return classes.select("c", "campo", "palabras").mapInArrow(run, KEYS)


def _key_batch(k, c, row, sets: Sets, short, p) -> pa.RecordBatch:
    arrays = [pa.array(k.view(np.int64)), c.take(pa.array(row)), pa.array(sets.n[row].astype(np.int32)), pa.array(sets.marks()[row].view(np.int64)), pa.array(short), pa.array(p.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["k", "c", "n", "marcas", "corta", "p"])


def longer_keys(rows: DataFrame, classes: DataFrame, common: list[str], threshold: float, level: int) -> DataFrame:
    """KEYS with one more word for keys (k, c, p) of `level` words."""

    def run(batches):
        rank = {w: i for i, w in enumerate(reversed(common))}
        for b in batches:
            if not b.num_rows:
                continue
            sets = Sets(b.column("palabras"), rank, threshold)
            p, k = b.column("p").to_numpy().astype(np.int64), b.column("k").to_numpy().view(np.uint64)
            last = np.minimum(sets.n - sets.shared + level, sets.n - 1)
            more = np.maximum(last - p, 0)
            row = np.repeat(np.arange(len(p)), more)
            if not len(row):
                continue
            at = p[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
            yield _key_batch(_longer(k[row], sets.h[sets.offsets[row] + at]), b.column("c"), row, sets, at <= (sets.n - sets.shared_short)[row] + level, at)

    return rows.select("k", "c", "p").join(classes.select("c", "palabras"), "c").mapInArrow(run, KEYS)


def _pairs_within(sizes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i before j, inside consecutive groups of the given sizes; i among a group's first rows only."""
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    later = np.repeat(starts + sizes, sizes) - np.arange(n) - 1
    later = np.where(np.arange(n) - np.repeat(starts, sizes) < np.repeat(firsts, sizes), later, 0)
    i = np.repeat(np.arange(n), later)
    ends = np.cumsum(later)
    j = np.arange(int(ends[-1]) if n else 0) - np.repeat(ends - later, later) + i + 1
    return i, j


def _group_pairs(k, c, n, marks, short, threshold: float):
    """Pairs (c1 < c2) of the buckets k that size and marks allow, made in blocks."""
    order = np.lexsort((~short, k))
    k, c, n, marks, short = k[order], c[order], n[order], marks[order], short[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    sizes = np.diff(np.append(starts, len(k)))
    firsts = np.add.reduceat(short.astype(np.int64), starts)
    pairs = firsts * (2 * sizes - firsts - 1) // 2
    edges = np.flatnonzero(np.diff(np.cumsum(pairs) // 1_000_000)) + 1
    for g in np.split(np.arange(len(sizes)), edges):
        i, j = _pairs_within(sizes[g], firsts[g])
        i, j = i + starts[g[0]], j + starts[g[0]]
        need = _fewest(n[i] + n[j], threshold / (1 + threshold))
        keep = (c[i] != c[j]) & (np.minimum(n[i], n[j]) >= need) & (short[j] | (n[i] <= n[j]))
        i, j, need = i[keep], j[keep], need[keep]
        keep = (np.bitwise_count(marks[i] & ~marks[j]) <= n[i] - need) & (np.bitwise_count(marks[j] & ~marks[i]) <= n[j] - need)
        a, b = c[i[keep]], c[j[keep]]
        if len(a):
            yield np.minimum(a, b), np.maximum(a, b)


def bucket_pairs(keys: DataFrame, threshold: float) -> DataFrame:
    """c1 < c2 of the candidates of all buckets (a pair may come several times)."""

    def run(batches):
        rest: list = []  # batches of the last bucket so far
        for b in batches:
            k = b.column("k").to_numpy()
            done = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if done:
                yield from emit(pa.Table.from_batches([*rest, b.slice(0, done)]))
                rest = []
            rest.append(b.slice(done))
        if rest:
            yield from emit(pa.Table.from_batches(rest))

    def emit(t):
        k = t.column("k").to_numpy()
        new = np.append(True, k[1:] != k[:-1])
        some = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(some):
            return
        c, n, marks, short = (t.column(x).to_numpy()[some] for x in ("c", "n", "marcas", "corta"))
        found = list(_group_pairs(k[some], c, n.astype(np.int64), marks.view(np.uint64), short, threshold))
        if found:
            pairs = np.unique(np.stack([np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["c1", "c2"])

    tasks = 2 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a class comes in several buckets
    return keys.select("k", "c", "n", "marcas", "corta").repartition(tasks, "k").sortWithinPartitions("k").mapInArrow(run, "c1 bigint, c2 bigint")


def candidate_pairs(classes: DataFrame, common: list[str], threshold: float, bands: bool = True, prefix: bool = True) -> DataFrame:
    """c1 < c2 of all classes that meet in a bucket and may reach the threshold."""
    keys, level, out = cut(bucket_keys(classes, common, threshold, bands, prefix), "keys"), 1, []
    full = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9)  # words that a class need not share
    while True:
        size, short = F.count("*"), F.count_if("corta")
        counts = keys.groupBy("k").agg(size.alias("m"), short.alias("s")).filter(F.col("s") * F.col("m") > SPLIT * SPLIT)
        hot = cut(counts, "hot")
        out.append(keys.join(hot.select("k"), "k", "left_anti"))
        if hot.isEmpty():
            break
        inside = cut(keys.filter("p >= 0").join(hot, "k"), "inside")
        # what a pair must share at least is used up: compare in blocks, so that no task gets a whole bucket
        blocks = F.ceil(F.col("m") / SPLIT).cast("int")
        used = inside.filter(F.col("n") - full <= level).withColumn("b", blocks).withColumn("x", F.pmod(F.xxhash64("c"), F.col("b")).cast("int"))
        used = used.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        out.append(used.withColumn("k", F.xxhash64("k", F.least("x", "y"), F.greatest("x", "y"))).select("k", "c", "n", "marcas", "corta", "p"))
        keys = cut(longer_keys(inside, classes, common, threshold, level), "keys")
        level += 1
    pairs = [bucket_pairs(x, threshold) for x in out]
    all_pairs = pairs[0]
    for x in pairs[1:]:
        all_pairs = all_pairs.unionByName(x)
    return all_pairs


def class_links(classes: DataFrame, common: list[str], threshold: float, bands: bool = True, prefix: bool = True) -> DataFrame:
    """c1 < c2 of all classes whose word sets share at least threshold of their union."""
    pairs = candidate_pairs(classes, common, threshold, bands, prefix).repartition("c1").distinct()
    own = classes.select("c", "palabras")
    both = pairs.join(own.select(F.col("c").alias("c1"), F.col("palabras").alias("p1")), "c1").join(own.select(F.col("c").alias("c2"), F.col("palabras").alias("p2")), "c2")
    one, two = F.split("p1", " "), F.split("p2", " ")
    shared = F.size(F.array_intersect(one, two))
    return both.filter(shared >= threshold * (F.size(one) + F.size(two) - shared) - 1e-9).select("c1", "c2")


def similar_classes(df: DataFrame, key: str, fields: list[Field], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members: key, c; links: c1, c2), both as tables in the shared folder."""
    members, classes = text_classes(df, key, fields)
    return members, cut(class_links(classes, frequent_words(classes), threshold), "links")


def text_classes(df: DataFrame, key: str, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(members: key, c; classes: c, campo, palabras); c numbers the distinct sets in the written table."""
    digest = F.unhex(F.md5(F.concat_ws(" ", F.col("campo").cast("string"), "palabras")))
    sets = cut(word_sets(df, key, fields).withColumn("d", digest), "sets")
    classes = cut(sets.groupBy("d").agg(F.first("campo").alias("campo"), F.first("palabras").alias("palabras")).withColumn("c", F.monotonically_increasing_id()), "classes")
    return cut(sets.select(key, "d").join(classes.select("d", "c"), "d").select(key, "c"), "members"), classes.select("c", "campo", "palabras")


def row_links(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """a < b: the linked rows, each pair once."""
    left, right = members.select(F.col(key).alias("a"), "c"), members.select(F.col(key).alias("b"), "c")
    same = left.join(right, "c").filter("a < b").select("a", "b")
    across = links.join(left.withColumnRenamed("c", "c1"), "c1").join(right.withColumnRenamed("c", "c2"), "c2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    return same.unionByName(across).distinct()


def shared_partners(members: DataFrame, both: DataFrame, key: str) -> DataFrame:
    """key, s: other rows that a row with two classes (one per field) is linked with through either field.

    Rows of the same two classes are counted together. Of a row's two classes the one that leads to
    fewer such pairs is followed, the other is then looked up. both: c1, c2 in either direction.
    """
    two = members.groupBy(key).agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y")
    kinds = cut(two.groupBy("x", "y").agg(F.count("*").alias("m")), "kinds")
    ends = cut(kinds.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("o")), F.struct(F.col("y").alias("c"), F.col("x").alias("o")))).alias("e"), "m").select("e.c", "e.o", "m"), "ends")
    own = ends.select("c").distinct()
    near = cut(both.select("c1", "c2").unionByName(own.select(F.col("c").alias("c1"), F.col("c").alias("c2"))), "near")  # a class is near itself
    reach = near.join(ends.groupBy(F.col("c").alias("c2")).agg(F.count("*").alias("k")), "c2").groupBy(F.col("c1").alias("c")).agg(F.sum("k").alias("k"))
    led = kinds.select("x", "y").join(reach.select(F.col("c").alias("x"), F.col("k").alias("kx")), "x").join(reach.select(F.col("c").alias("y"), F.col("k").alias("ky")), "y")
    first = F.col("kx") <= F.col("ky")
    led = led.select("x", "y", F.when(first, F.col("x")).otherwise(F.col("y")).alias("c1"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("o1"))
    met = led.join(near, "c1").join(ends.select(F.col("c").alias("c2"), F.col("o").alias("o2"), "m"), "c2").select("x", "y", "o1", "o2", "m")
    found = met.join(near.select(F.col("c1").alias("o1"), F.col("c2").alias("o2")), ["o1", "o2"]).groupBy("x", "y").agg((F.sum("m") - 1).alias("s"))
    return two.join(found, ["x", "y"]).select(key, "s")


def groups(df: DataFrame, members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key, grupo (least key of the group), enlaces (other rows that the row is linked with through either field, copies included)
    of every row of df; a row without links is a group of its own."""
    sizes = members.groupBy("c").agg(F.count("*").alias("n"), F.min(key).alias("primero"))
    # a row's classes (one per field) are tied through the row itself
    own = members.groupBy(key).agg(F.min("c").alias("u"), F.max("c").alias("v")).filter("u <> v").select("u", "v")
    comp = components(links.select(F.col("c1").alias("u"), F.col("c2").alias("v")).unionByName(own))
    label = sizes.join(comp, sizes["c"] == comp["nodo"], "left").select("c", "primero", F.coalesce("componente", "c").alias("comp"))
    named = label.join(label.groupBy("comp").agg(F.min("primero").alias("grupo")), "comp").select("c", "grupo")
    both = links.unionByName(links.select(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    degree = both.join(sizes.select(F.col("c").alias("c2"), "n"), "c2").groupBy(F.col("c1").alias("c")).agg(F.sum("n").alias("d"))
    per_class = named.join(sizes.select("c", "n"), "c").join(degree, "c", "left").select("c", "grupo", (F.coalesce("d", F.lit(0)) + F.col("n") - 1).alias("d"))
    rows = members.join(per_class, "c").groupBy(key).agg(F.min("grupo").alias("grupo"), F.sum("d").alias("enlaces"))
    rows = rows.join(shared_partners(members, both, key), key, "left").withColumn("enlaces", F.col("enlaces") - F.coalesce("s", F.lit(0)))
    return df.select(key).join(rows, key, "left").select(key, F.coalesce("grupo", key).alias("grupo"), F.coalesce("enlaces", F.lit(0)).alias("enlaces"))
