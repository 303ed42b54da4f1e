"""Clusters of records that report one event (problem 5).

1. Each title gets its language and stretches (the operator of problem 1) and its names:
   the words that aren't common words of all distinct titles nor one edit away from one.
   What a title says of whom and where is in its names; the wording is not. A title without
   names has its own words in their order for a name, so that it links with its copies.
2. Rows with the same language and names are one leaf entry: a cluster feature (count n, linear
   sum LS, square sum SS of unit vectors of hashed letter groups of the names, so that a
   misspelt name stays near). Features add up, so they are drawn together in every partition
   and along the shuffle, and copies weigh in counts, not in work; of equal vectors the count
   tells LS and SS.
3. Entries are routed to the blocks of their names. Each block grows a tree of cluster
   features: an entry goes down to the nearest child, is absorbed where the radius of the
   merged feature stays within `RADIUS`, and nodes of more than `BRANCH` features are divided
   by their two farthest ones. The tree's leaf features are then agglomerated by Ward's cost
   n1 n2 / (n1 + n2) d^2 of their centroids, cheapest join first, features added up and costs
   renewed after each, while the centroids of the two are within `WARD`. The blocks'
   summaries are reduced over the shuffle: an entry follows the heaviest entry of any cluster
   that it is in, and so on up to a root.
4. One full pass assigns all rows to their root; a cluster is cut where a span of 72 hours
   is empty. A cluster's typical member is the one nearest to its centroid.
5. Links of rows need the same cluster, at most `hours` between their instants, and names
   that agree (misspelt ones are matched up to two edits).

Blocks are counted before they are made. One of more than `SPLIT` entries is divided by a
second name that two of its entries share (or nearly share: letters left out make the keys),
and then by a third; entries without a further name are put beside all others of the block.
Entries that share only a hot name contradict each other, so nothing is lost. Links are
found by time buckets. Defined cases: rows without title, letters or usable instant are in no
link and are clusters of their own; a title in several languages links only with
captures of its own page; exact copies link; ties go to the smaller id; empty tables give
empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brujula.functions.dates import INVALID
from brujula.functions.text import fold, words
from brujula.functions.urls import page_keys
from brujula.llm import languages
from brujula.llm.sketches import mixed
from brujula.operators import timestamps
from brujula.session import cut

DIMENSIONS = 96
WARD = 0.25  # half the squared distance of two centroids up to which they may join
RADIUS, BRANCH = 0.04, 16  # squared radius of a leaf feature, features of a tree's node
SPLIT = 512  # entries of a block
ALONE = 0.6  # greatest cosine with others under which an entry is within WARD of no centroid of them
HOURS = 72


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


class Names:
    """Tells the names of a text from common words."""

    def __init__(self, common: set[str]):
        self.common = common
        self.deletes = {x for w in common if len(w) > 3 for x in _deletes(w)}
        self.known: dict[str, bool] = {}

    def is_name(self, w: str) -> bool:
        got = self.known.get(w)
        if got is None:
            got = len(w) > 3 and w not in self.common
            if got:
                d = _deletes(w)
                got = w not in self.deletes and self.common.isdisjoint(d) and self.deletes.isdisjoint(d)
            if len(self.known) > 2_000_000:
                self.known.clear()
            self.known[w] = got
        return got

    def of(self, words: list[str]) -> str:
        return " ".join(sorted({w for w in words if self.is_name(w)}))


#: One unrelated title in so many makes a word common; rows of `least` titles at any size are too few to tell.
EVERY, LEAST = 6000, 3


def title_words(text: str) -> list[str]:
    """Distinct folded words of a title, runs of letters with digits inside included."""
    pieces = [fold(w) for w in languages.WORD.findall(text)]
    return list(dict.fromkeys([*pieces, *(w for w in words(text) if not w.isalpha() and not w.isdigit())]))


def _long(ws: list[str]) -> list[str]:
    return [w for w in ws if len(w) > 3]


def head_counts(lists, df: dict[str, int], least: float) -> Counter:
    """(word, head): titles of each word of at least `least` titles by their head, the rarest other word.

    df has the words of at least least / 4 titles; a title with a rarer one gets no head, since
    such a word can't tie a large part of the other's titles together.
    """
    out: Counter = Counter()
    for ws in lists:
        known = sorted((df[w], w) for w in _long(ws) if w in df)
        if len(known) < len(_long(ws)):
            continue
        for w in ws:
            head = next((x for _, x in known[:2] if x != w), None)
            if head is not None and df.get(w, 0) >= least:
                out[w, head] += 1
    return out


def bare_pairs(lists, common: set[str]) -> Counter:
    """(word, word): titles without names that hold both."""
    out: Counter = Counter()
    for ws in lists:
        if common.issuperset(_long(ws)):
            out.update(combinations(sorted(_long(ws)), 2))
    return out


def spread_words(df: dict[str, int], tops: dict[str, list[int]], least: float) -> set[str]:
    """Words of at least `least` titles, but those of which two heads hold half of the titles."""
    tied = {w for w, t in tops.items() if t[0] >= 2 and sum(t[:2]) >= df[w] / 2}
    return {w for w, n in df.items() if n >= least} - tied


def without_hot(common: set[str], df: dict[str, int], pairs: dict[tuple[str, str], int]) -> set[str]:
    """common without the names of hot actors: two words that share half of the titles of either, and
    these without any other name. Their misspelt forms are no common words either."""
    hot = {w for pair, n in pairs.items() if n >= max(df[pair[0]], df[pair[1]]) / 2 for w in pair}
    near = {w for w in common - hot if len(w) > 3 and any(df[w] < df[h] / 4 and _near(w, h) for h in hot)}
    return common - hot - near


def common_words(texts: list[str], least: int = LEAST, every: int = EVERY) -> set[str]:
    """Folded words that many unrelated ones of the distinct texts hold (see `corpus_common_words`)."""
    lists = [title_words(t) for t in dict.fromkeys(texts)]
    at = max(least, len(lists) / every)
    df = {w: n for w, n in Counter(w for ws in lists for w in ws).items() if n >= at / 4}
    tops: dict[str, list[int]] = {}
    for (w, _), n in head_counts(lists, df, at).items():
        tops.setdefault(w, []).append(n)
    common = spread_words(df, {w: sorted(t, reverse=True) for w, t in tops.items()}, at)
    return without_hot(common, df, bare_pairs(lists, common))


def _counted(lists: DataFrame, count, columns: list[str]) -> DataFrame:
    """Sums of the counters that `count` makes of batches of word lists, drawn together per task first."""

    def run(batches):
        total: Counter = Counter()

        def out():
            keys = [k if isinstance(k, tuple) else (k,) for k in total]
            arrays = [pa.array([k[i] for k in keys], type=pa.string()) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(total.values()), type=pa.int64())], names=[*columns, "n"])

        for b in batches:
            total.update(count([x.split(" ") for x in b.column("palabras").to_pylist()]))
            if len(total) > 1_000_000:
                yield out()
                total.clear()
        yield out()

    kinds = ", ".join(f"{c} string" for c in columns)
    return lists.mapInArrow(run, f"{kinds}, n bigint").groupBy(*columns).agg(F.sum("n").alias("n"))


def corpus_common_words(news: DataFrame, least: int = LEAST, every: int = EVERY) -> set[str]:
    """The common words of all distinct titles.

    A word is common if at least one in `every` titles (and `least`) hold it and they aren't
    mostly tied together by the same further words. Only words of a share of the titles are
    brought to the driver, so their number is bounded by the words of a title, at any size.
    """

    def run(batches):
        for b in batches:
            lists = [" ".join(title_words(t)) for t in b.column("titulo").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, type=pa.string())], names=["palabras"])

    lists = cut(news.select("titulo").filter(F.col("titulo").isNotNull()).distinct().mapInArrow(run, "palabras string"), "titles")
    at = max(least, lists.count() / every)
    df = {r["w"]: r["n"] for r in _counted(lists, lambda ls: Counter(w for ws in ls for w in ws if w), ["w"]).filter(F.col("n") >= at / 4).collect()}
    heads = _counted(lists, lambda ls: head_counts(ls, df, at), ["w", "x"])
    tops = heads.groupBy("w").agg(F.slice(F.sort_array(F.collect_list("n"), False), 1, 2).alias("t")).collect()
    common = spread_words(df, {r["w"]: r["t"] for r in tops}, at)
    pairs = _counted(lists, lambda ls: bare_pairs(ls, common), ["w", "x"]).filter(F.col("n") >= at / 2).collect()
    return without_hot(common, df, {(r["w"], r["x"]): r["n"] for r in pairs})


def own_name(text: str) -> str:
    """What stands for the names of a title without any: only the same words in the same order equal it."""
    return "=" + hashlib.blake2b(" ".join(words(text)).encode(), digest_size=8).hexdigest()


def described(news: DataFrame, outlets: DataFrame, model: tuple, common: set[str]) -> DataFrame:
    """fila, lengua, varias, t (microseconds), nombres, pagina of the rows that may link."""
    tables = timestamps.outlet_zones(outlets)
    rows = timestamps.with_outlet_zone(news.filter(F.col("titulo").isNotNull()), outlets, ["fila", "titulo", "url", "fecha_publicacion", "fecha_deteccion"])

    def run(batches):
        labeller, names = languages.Labeller(*model), Names(common)
        for b in batches:
            texts = b.column("titulo").to_pylist()
            found = labeller.stretches(texts, confidence=True)
            t = timestamps.field_micros(b, "fecha_publicacion", True, tables)
            t = np.where(t == INVALID, timestamps.field_micros(b, "fecha_deteccion", False, tables), t)
            take = np.array([bool(s) for s in found]) & (t != INVALID)
            at = np.flatnonzero(take).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("fila").filter(pa.array(take)),
                    pa.array([found[i][0][0] for i in at], type=pa.int8()),
                    pa.array([len(found[i]) > 1 for i in at], type=pa.bool_()),
                    pa.array(t[at], type=pa.int64()),
                    pa.array([names.of([fold(w) for w in languages.WORD.findall(texts[i])]) or own_name(texts[i]) for i in at], type=pa.string()),
                    page_keys(b.column("url").filter(pa.array(take))),
                ],
                names=["fila", "lengua", "varias", "t", "nombres", "pagina"],
            )

    out = rows.mapInArrow(run, "fila bigint, lengua tinyint, varias boolean, t bigint, nombres string, pagina string")
    return out.select("fila", "lengua", "varias", "t", "nombres", F.xxhash64("lengua", "nombres").alias("e"), F.when(F.col("pagina").isNotNull(), F.xxhash64("pagina")).alias("pagina"))


def name_vectors(sets: list[str]) -> np.ndarray:
    """Unit vectors (sets x DIMENSIONS) of space-separated names, by hashed groups of two letters with their edges."""
    lists = [s.split(" ") for s in sets]
    distinct = sorted({w for ws in lists for w in ws})
    code = {w: i for i, w in enumerate(distinct)}
    v = np.zeros((len(distinct), DIMENSIONS))
    if distinct:
        width = max(map(len, distinct)) + 2
        chars = np.array([f"^{w}$" for w in distinct], dtype=f"U{width}").view(np.uint32).reshape(len(distinct), width).astype(np.uint64)
        for gap in (1, 2):  # neighbours, and letters with one between them, which a transposition keeps in part
            h = mixed((chars[:, :-gap] << np.uint64(21)) | chars[:, gap:] | np.uint64(gap << 60))
            row, col = np.nonzero(chars[:, gap:])
            own = h[row, col]
            np.add.at(v, (row, (own % np.uint64(DIMENSIONS)).astype(np.int64)), np.where(own >> np.uint64(63), 1.0, -1.0))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    sizes = np.array([len(ws) for ws in lists])
    flat = np.fromiter((code[w] for ws in lists for w in ws), dtype=np.int64, count=int(sizes.sum()))
    out = np.add.reduceat(v[flat], np.cumsum(sizes) - sizes, axis=0) if len(lists) else np.zeros((0, DIMENSIONS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Node:
    """A node of a tree of cluster features: counts and linear sums of its features, and their nodes or entries."""

    def __init__(self, leaf: bool):
        self.leaf, self.n, self.below = leaf, np.zeros(BRANCH + 1), []
        self.ls = np.zeros((BRANCH + 1, DIMENSIONS))

    def put(self, n: float, ls: np.ndarray, below) -> None:
        k = len(self.below)
        self.n[k], self.ls[k] = n, ls
        self.below.append(below)

    def total(self) -> tuple[float, np.ndarray]:
        k = len(self.below)
        return self.n[:k].sum(), self.ls[:k].sum(axis=0)


class FeatureTree:
    """Cluster features of unit vectors by nearest descent. SS of unit vectors is n, so the squared radius of a
    feature is 1 - |LS / n|^2."""

    def __init__(self):
        self.root = Node(True)

    def insert(self, n: float, v: np.ndarray, entry: int) -> None:
        halves = self._into(self.root, n, v, entry)
        if halves:
            self.root = Node(False)
            for h in halves:
                self.root.put(*h.total(), h)

    def _into(self, node: Node, n: float, v: np.ndarray, entry: int) -> list[Node] | None:
        k = len(node.below)
        if k:
            d = node.ls[:k] / node.n[:k, None] - v
            at = int(np.einsum("ij,ij->i", d, d).argmin())
            if not node.leaf:
                halves = self._into(node.below[at], n, v, entry)
                if halves is None:
                    node.n[at] += n
                    node.ls[at] += n * v
                    return None
                node.n[at], node.ls[at] = halves[0].total()
                node.below[at] = halves[0]
                node.put(*halves[1].total(), halves[1])
                return self._divided(node)
            ls = node.ls[at] + n * v
            if 1 - ls @ ls / (node.n[at] + n) ** 2 <= RADIUS:
                node.n[at] += n
                node.ls[at] = ls
                node.below[at].append(entry)
                return None
        node.put(n, n * v, [entry])
        return self._divided(node)

    @staticmethod
    def _divided(node: Node) -> list[Node] | None:
        k = len(node.below)
        if k <= BRANCH:
            return None
        mu = node.ls[:k] / node.n[:k, None]
        g = mu @ mu.T
        d = np.diag(g)[:, None] + np.diag(g)[None, :] - 2 * g
        a, b = divmod(int(d.argmax()), k)
        halves = [Node(node.leaf), Node(node.leaf)]
        for i in range(k):
            halves[int(d[i, b] < d[i, a]) if i not in (a, b) else int(i == b)].put(node.n[i], node.ls[i], node.below[i])
        return halves

    def features(self) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """(n, LS, entries) of the leaf features."""
        n, ls, below, todo = [], [], [], [self.root]
        while todo:
            node = todo.pop()
            k = len(node.below)
            if node.leaf:
                n.append(node.n[:k])
                ls.append(node.ls[:k])
                below += node.below
            else:
                todo += node.below
        return np.concatenate(n), np.concatenate(ls), below


def ward(n: np.ndarray, ls: np.ndarray) -> list[list[int]]:
    """Clusters (indices) of features: the join with the least increase of the square sum first, while centroids are near."""
    n, ls = n.copy(), ls.copy()
    mu = ls / n[:, None]
    g = mu @ mu.T
    d = np.maximum(np.diag(g)[:, None] + np.diag(g)[None, :] - 2 * g, 0)
    cost = np.where(d / 2 <= WARD, n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * d, np.inf)
    np.fill_diagonal(cost, np.inf)
    own: list[list[int]] = [[i] for i in range(len(n))]
    alive = np.ones(len(n), dtype=bool)
    while len(n) > 1:
        i, j = divmod(int(cost.argmin()), len(n))
        if cost[i, j] == np.inf:
            break
        i, j = min(i, j), max(i, j)
        own[i] += own[j]
        n[i] += n[j]
        ls[i] += ls[j]
        mu[i] = ls[i] / n[i]
        alive[j], own[j] = False, []
        d = mu - mu[i]
        d = np.einsum("ij,ij->i", d, d)
        row = np.where(alive & (d / 2 <= WARD), n * n[i] / (n + n[i]) * d, np.inf)
        row[i] = np.inf
        cost[i], cost[:, i], cost[j], cost[:, j] = row, row, np.inf, np.inf
    return [x for x in own if x]


def block_roots(sizes: np.ndarray, e: np.ndarray, n: np.ndarray, vectors: np.ndarray):
    """(entry, weight, heaviest entry of its cluster) of consecutive blocks; entries come by falling weight, then id."""
    starts = np.append(0, np.cumsum(sizes)).tolist()
    for a, b in zip(starts, starts[1:]):
        v = vectors[a:b]
        near = v @ v.T
        np.fill_diagonal(near, -1)
        some = np.flatnonzero(near.max(axis=1) >= ALONE)
        if len(some) < 2:
            continue
        tree = FeatureTree()
        for i in some.tolist():
            tree.insert(float(n[a + i]), v[i], i)
        weights, sums, entries = tree.features()
        for cluster in ward(weights, sums):
            members = [i for x in cluster for i in entries[x]]
            if len(members) > 1:
                head = a + min(members)
                rest = np.array([a + i for i in members if a + i != head])
                yield e[rest], np.full(len(rest), n[head]), np.full(len(rest), e[head])


def _left_out(word: str) -> set[str]:
    """The word and what it is with one or two letters left out: words within two edits share one of these."""
    once = _deletes(word)
    return {word} | once | {x for w in once for x in _deletes(w)}


def named_blocks(leaves: DataFrame) -> DataFrame:
    """k (block), e, n, nombres: the entries at the blocks of their names, none with more than about SPLIT entries."""
    names = F.split("nombres", " ")
    blocks = leaves.select(F.posexplode(names).alias("i", "w"), "lengua", "e", "n", "nombres").select(F.xxhash64("lengua", "w").alias("k"), F.array("i").alias("usados"), "e", "n", "nombres")
    out, level = [], 1
    while True:
        hot = cut(blocks.groupBy("k").agg(F.count("*").alias("m")).filter(F.col("m") > SPLIT), "hot")
        out.append(blocks.join(hot.select("k"), "k", "left_anti").select("k", "e", "n", "nombres"))
        if hot.isEmpty():
            break
        inside = blocks.join(hot, "k").withColumn("b", F.ceil(F.col("m") / SPLIT).cast("int")).withColumn("x", F.pmod(F.xxhash64("e"), F.col("b")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("b") - 1))
        if level == 3:  # who shares three names need share no more: all pairs of parts
            parts = inside.withColumn("y", every)
            out.append(parts.select(F.xxhash64("k", F.least("x", "y"), F.greatest("x", "y")).alias("k"), "e", "n", "nombres"))
            break
        done = F.size(names) == level
        beside = inside.filter(done).withColumn("y", every).unionByName(inside.filter(~done).withColumn("y", F.col("x")))
        out.append(beside.select(F.xxhash64("k", "y", F.lit(level)).alias("k"), "e", "n", "nombres"))

        def further(batches):
            for b in batches:
                used, lists = b.column("usados").to_pylist(), [x.split(" ") for x in b.column("nombres").to_pylist()]
                rows = [(r, [*used[r], i], x) for r, ws in enumerate(lists) for i, w in enumerate(ws) if i not in used[r] for x in sorted(_left_out(w))]
                at = pa.array([r for r, _, _ in rows], type=pa.int64())
                columns = [b.column("k").take(at), pa.array([x for _, _, x in rows], type=pa.string()), pa.array([u for _, u, _ in rows], type=pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, *[b.column(c).take(at) for c in ("e", "n", "nombres")]], names=["k", "x", "usados", "e", "n", "nombres"])

        longer = inside.filter(~done).select("k", "usados", "e", "n", "nombres").mapInArrow(further, "k bigint, x string, usados array<int>, e bigint, n bigint, nombres string")
        blocks = cut(longer.select(F.xxhash64("k", "x").alias("k"), "usados", "e", "n", "nombres").dropDuplicates(["k", "e"]), "blocks")
        level += 1
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def leaf_joins(leaves: DataFrame) -> DataFrame:
    """e, raiz: the root of each entry (e, n, nombres, lengua) that joins another one."""
    blocks = named_blocks(leaves)

    def run(batches):
        rest: list = []  # batches of the last block so far
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
        k, e, n = k[some], t.column("e").to_numpy()[some], t.column("n").to_numpy()[some]
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)))
        found = list(block_roots(sizes, e, n, name_vectors(t.column("nombres").take(pa.array(some)).to_pylist())))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], names=["e", "peso", "hacia"])

    found = blocks.repartition("k").sortWithinPartitions("k", F.desc("n"), "e").mapInArrow(run, "e bigint, peso bigint, hacia bigint")
    to = found.groupBy("e").agg(F.max(F.struct("peso", (-F.col("hacia").cast("decimal(20,0)")).alias("m"), "hacia")).alias("x")).select("e", F.col("x.hacia").alias("raiz"))
    to = cut(to, "joins")
    while True:  # each step halves the chains; a chain always goes to heavier entries, so it ends
        step = to.select(F.col("e").alias("raiz"), F.col("raiz").alias("luego"))
        moved = cut(to.join(step, "raiz", "left").select("e", F.coalesce("luego", "raiz").alias("raiz"), F.col("luego").isNotNull().alias("movido")), "roots")
        to = moved.select("e", "raiz")
        if moved.filter("movido").isEmpty():
            return to


def clustered(rows: DataFrame) -> DataFrame:
    """The rows of `described` with their root."""
    leaves = rows.filter("NOT varias AND nombres <> ''").groupBy("e", "lengua", "nombres").agg(F.count("*").alias("n"))
    roots = leaf_joins(cut(leaves, "leaves"))
    return rows.join(roots, "e", "left").withColumn("raiz", F.when(F.col("varias") | (F.col("nombres") == ""), F.xxhash64("fila", F.lit("sola"))).otherwise(F.coalesce("raiz", "e")))


def _near(a: str, b: str, most: int = 2) -> bool:
    """At most `most` edits (neighbours changing places count as one)."""
    if abs(len(a) - len(b)) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


def agree(a: str, b: str) -> bool:
    """Whether the names don't contradict each other: not both hold a name that the other lacks,
    or they share three (an actor's two and the place), beside which other words are no names."""
    if a == b:
        return True
    x, y = set(a.split(" ")), set(b.split(" "))
    left, right = x - y, y - x
    for w in sorted(left):
        for z in sorted(right):
            if _near(w, z):
                left.discard(w)
                right.discard(z)
                break
    shared = min(len(x) - len(left), len(y) - len(right))
    return shared >= 3 or (not (left and right) and shared >= min(2, len(x), len(y)))


def event_links(rows: DataFrame, hours: int = HOURS) -> DataFrame:
    """a < b of the clustered rows that report one event."""
    span = hours * 3600 * 1_000_000
    bucket = F.floor(F.col("t") / span).cast("long")
    one = rows.filter("NOT varias AND nombres <> ''").select("raiz", "fila", "t", "nombres", bucket.alias("g"))
    left = one.select("raiz", "g", F.col("fila").alias("a"), F.col("t").alias("ta"), F.col("nombres").alias("na"))
    right = one.select("raiz", F.explode(F.array(F.col("g"), F.col("g") + 1)).alias("g"), F.col("g").alias("gb"), F.col("fila").alias("b"), F.col("t").alias("tb"), F.col("nombres").alias("nb"))
    near = left.join(right, ["raiz", "g"]).filter((F.abs(F.col("ta") - F.col("tb")) <= span) & ((F.col("g") != F.col("gb")) | (F.col("a") < F.col("b"))))

    def check(batches):
        for b in batches:
            both = pc.binary_join_element_wise(b.column("na"), b.column("nb"), "|").dictionary_encode()
            told = np.array([agree(*x.split("|")) for x in both.dictionary.to_pylist()], dtype=bool)
            ok = told[both.indices.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    alike = near.select("a", "b", "na", "nb").mapInArrow(check, "a bigint, b bigint")
    several = rows.filter("varias AND pagina IS NOT NULL").select("pagina", F.col("fila").alias("a"), F.col("t").alias("ta"))
    page = rows.filter("pagina IS NOT NULL").select("pagina", F.col("fila").alias("b"), F.col("t").alias("tb"))
    own = several.join(page, "pagina").filter((F.col("a") != F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= span)).select("a", "b").distinct()
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered(alike).unionByName(ordered(own).distinct())


def event_clusters(rows: DataFrame, hours: int = HOURS) -> DataFrame:
    """fila, nombres, cluster of the clustered rows: a root's rows, cut where a bucket of `hours` is empty.

    The buckets of a root are counted first, so the window sees at most one row per root and bucket.
    """
    from pyspark.sql import Window

    g = F.floor(F.col("t") / (hours * 3600 * 1_000_000)).cast("long")
    rows = rows.withColumn("g", g)
    w = Window.partitionBy("raiz").orderBy("g")
    spans = rows.select("raiz", "g").distinct().withColumn("nuevo", (F.col("g") - F.lag("g", 1, -(2**40)).over(w) > 1).cast("int")).withColumn("tramo", F.sum("nuevo").over(w))
    return rows.join(spans.select("raiz", "g", "tramo"), ["raiz", "g"]).select("fila", "nombres", F.xxhash64("raiz", "tramo").alias("cluster"))


def typical_members(members: DataFrame) -> DataFrame:
    """cluster, tamano, fila of the member nearest to the centroid (ties: most copies, then smallest fila)."""
    leaves = cut(members.groupBy("cluster", "nombres").agg(F.count("*").alias("n"), F.min("fila").alias("fila")), "entries")

    def features(batches):
        """Partial cluster features (n, linear sum) of each cluster in a batch."""
        for b in batches:
            c, n = b.column("cluster").to_numpy(), b.column("n").to_numpy()
            v = name_vectors(b.column("nombres").to_pylist()) * n[:, None]
            ids, inverse = np.unique(c, return_inverse=True)
            total = np.zeros((len(ids), DIMENSIONS))
            np.add.at(total, inverse, v)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(inverse, n, len(ids)).astype(np.int64)), pa.array(total.tolist(), type=pa.list_(pa.float64()))], names=["cluster", "n", "ls"])

    several = leaves.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("tamano"), F.min("fila").alias("fila"))
    mixed_ones = leaves.join(several.filter("k > 1").select("cluster", "tamano"), "cluster")
    partial = mixed_ones.mapInArrow(features, "cluster bigint, n bigint, ls array<double>")
    sums = partial.groupBy("cluster").agg(*[F.sum(F.col("ls")[i]).alias(f"s{i}") for i in range(DIMENSIONS)])
    centroids = sums.select("cluster", F.array(*[F.col(f"s{i}") for i in range(DIMENSIONS)]).alias("ls"))

    def distance(batches):
        for b in batches:
            v = name_vectors(b.column("nombres").to_pylist())
            centre = np.array(b.column("ls").flatten().to_numpy()).reshape(-1, DIMENSIONS)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
            d = np.round(1 - np.einsum("ij,ij->i", v, centre), 9)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("cluster", "tamano", "fila", "n")], pa.array(d)], names=["cluster", "tamano", "fila", "n", "d"])

    near = mixed_ones.join(centroids, "cluster").select("cluster", "tamano", "fila", "n", "nombres", "ls").mapInArrow(distance, "cluster bigint, tamano bigint, fila bigint, n bigint, d double")
    best = near.groupBy("cluster").agg(F.max("tamano").alias("tamano"), F.min(F.struct("d", (-F.col("n")).alias("m"), "fila")).alias("b")).select("cluster", "tamano", F.col("b.fila").alias("fila"))
    return several.filter("k = 1").select("cluster", "tamano", "fila").unionByName(best)
