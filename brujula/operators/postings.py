"""Lists of postings in numpy (no Spark): ranked search in a slice of passages, greatest cosines in a stretch of time.

Spark deals the rows to slices of bounded size; inside a slice words are numbers, so that counting
what two texts share is adding to an array instead of joining rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The entries of a column of lists and where each list begins (one more at the end)."""
    return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Position of each word in known, -1 where it isn't there."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows by code, ascending inside a code; where each of n codes begins)."""
    order = np.argsort(codes, kind="stable")
    return rows[order], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))]).astype(np.int64)


def _entries(begins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of the given rows, and where each row begins among them."""
    sizes = begins[rows + 1] - begins[rows]
    first = np.cumsum(sizes) - sizes
    return np.repeat(begins[rows] - first, sizes) + np.arange(int(sizes.sum())), first


class Slice:
    """Passages (pasaje, reciente, ps distinct stems, cs content stems) of a slice, in the order that decides ties."""

    def __init__(self, passages: pa.Table, words: pa.Array, idf: np.ndarray):
        order = pc.sort_indices(passages.select(["pasaje", "reciente"]), sort_keys=[("reciente", "descending"), ("pasaje", "ascending")], null_placement="at_end")
        passages = passages.take(order).combine_chunks()
        self.named = passages.select(["pasaje", "reciente"])
        n = len(passages)
        flat, self.begins = _flat(passages.column("ps").chunk(0))
        coded = flat.dictionary_encode()
        self.words, size = coded.dictionary, len(coded.dictionary)
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(n), np.diff(self.begins))
        content, begins = _flat(passages.column("cs").chunk(0))
        keys, counts = np.unique(np.repeat(np.arange(n), np.diff(begins)) * size + _codes(content, self.words), return_counts=True)
        own = rows * size + self.codes
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        tf = np.where(keys[at] == own, counts[at], 0) if len(keys) else np.zeros(len(own), dtype=np.int64)
        known = _codes(self.words, words)
        weight = np.where(known >= 0, idf[known], 0.0) if len(idf) else np.zeros(size)
        v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0.0) * weight[self.codes]
        norm = np.sqrt(np.bincount(rows, v * v, minlength=n))
        self.y = v / np.where(norm > 0, norm, 1.0)[rows]
        self.posted, self.starts = _lists(self.codes, rows.astype(np.int32), size)
        self.codes = self.codes.astype(np.int32)
        self.counts = np.zeros(n, dtype=np.int32)

    def covering(self, own: np.ndarray, need: int) -> np.ndarray:
        """Passages that may hold `need` of the stems: of the rarest m - need + j of m stems they hold at least j."""
        own = own[np.argsort(self.starts[own + 1] - self.starts[own], kind="stable")]
        lists = [self.posted[self.starts[c] : self.starts[c + 1]] for c in own]
        first = len(own) - need + 1
        self.counts[:] = 0
        for x in lists[:first]:
            self.counts[x] += 1
        found = np.concatenate(lists[:first])
        for j, x in enumerate(lists[first:], 2):
            if len(x) > 32 * len(found):
                break  # what is left is read sooner than the list
            self.counts[x] += 1
            found = found[self.counts[found] >= j]
        return np.unique(found)

    def search(self, queries: pa.RecordBatch, k: int, least: float, coverage: float, boost: float) -> pa.Table:
        """consulta, pasaje, reciente, s of the k best passages of each query (consulta, ws, xs) in this slice."""
        flat, begins = _flat(queries.column("ws"))
        codes, x = _codes(flat, self.words), queries.column("xs").flatten().to_numpy(zero_copy_only=False)
        dated = pc.match_substring_regex(flat, "^(19|20)[0-9]{2}$").to_numpy(zero_copy_only=False)
        weight, asked, year = np.zeros(len(self.words)), np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.int64)
        who, what, score = [], [], []
        for i in range(len(queries)):
            mine = slice(begins[i], begins[i + 1])
            n, here = begins[i + 1] - begins[i], codes[mine] >= 0
            own, need = codes[mine][here], max(1, math.ceil(coverage * n - 1e-9))
            if len(own) < need or not len(found := self.covering(own, need)):
                continue
            weight[own], asked[own], year[own] = x[mine][here], 1, dated[mine][here]
            entries, first = _entries(self.begins, found)
            met = self.codes[entries]
            s = np.add.reduceat(weight[met] * self.y[entries], first)
            held = np.add.reduceat(asked[met], first)
            if dated[mine].any():
                s = s + np.where(np.add.reduceat(year[met], first) > 0, boost, 0.0)
            weight[own], asked[own], year[own] = 0, 0, 0
            good = (held >= coverage * n) & (s >= least)
            found, s = found[good], s[good]
            best = np.argsort(-np.round(s, 6), kind="stable")[:k]
            who.append(np.full(len(best), i))
            what.append(found[best])
            score.append(s[best])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, dtype=kind)
        out = self.named.take(pa.array(join(what, np.int64)))
        return pa.table({"consulta": queries.column("consulta").take(pa.array(join(who, np.int64))), "pasaje": out.column("pasaje"), "reciente": out.column("reciente"), "s": pa.array(join(score, np.float64))})


def search_slice(batches, k: int, least: float, coverage: float, boost: float):
    """Record batches of one slice's rows by `rol`: 0 weights (ws, xs), 1 passages (pasaje, reciente, ws, cs), 2 queries (consulta, ws, xs)."""
    held: tuple[list, list] = ([], [])
    ready = None
    for b in batches:
        at = np.searchsorted(b.column("rol").to_numpy(zero_copy_only=False), [0, 1, 2, 3])
        for r in (0, 1):
            if at[r + 1] > at[r]:
                held[r].append(b.slice(at[r], at[r + 1] - at[r]))
        if at[3] == at[2] or not held[1]:
            continue
        if ready is None:
            rows = pa.Table.from_batches(held[1]).select(["pasaje", "reciente", "ws", "cs"]).rename_columns(["pasaje", "reciente", "ps", "cs"])
            words = pa.concat_arrays([x.column("ws").flatten() for x in held[0]]) if held[0] else pa.array([], pa.string())
            idf = np.concatenate([x.column("xs").flatten().to_numpy(zero_copy_only=False) for x in held[0]]) if held[0] else np.zeros(0)
            ready = Slice(rows, words, idf)
            held[0].clear()
            held[1].clear()
            held[1].append(None)  # passages were there
        yield from ready.search(b.slice(at[2], at[3] - at[2]), k, least, coverage, boost).to_batches()


def greatest_before(rows: pa.Table, span: int) -> pa.Table:
    """id, s: the greatest cosine of each row of now with the rows of the past that are earlier by `span` at most; none without any.

    rows: id, t, past, ws (a number for each word of the text), es (that word's weight). A row that holds none of the words
    whose lists were read has at most the norm of the other words as its cosine, so reading ends once that is reached.
    """
    rows = rows.combine_chunks()
    t, past = rows.column("t").to_numpy(), rows.column("past").to_numpy(zero_copy_only=False)
    order, early = np.lexsort((t, ~past)), int(past.sum())
    place = np.empty(len(t), dtype=np.int64)
    place[order] = np.arange(len(t))
    flat, begins = _flat(rows.column("ws").chunk(0))
    words, first, codes = np.unique(flat.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    weight = rows.column("es").chunk(0).flatten().to_numpy(zero_copy_only=False)[first]
    keys, tf = np.unique(np.repeat(place, np.diff(begins)) * len(words) + codes, return_counts=True)
    owner, codes = keys // len(words), keys % len(words)
    v = tf * weight[codes]
    x = v / np.sqrt(np.bincount(owner, v * v, minlength=len(t)))[owner]
    begins = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(t)))]).astype(np.int64)
    edge = begins[early]
    sort = np.argsort(codes[:edge], kind="stable")
    posted, y, where = owner[:edge][sort], x[:edge][sort], codes[:edge][sort] * early + owner[:edge][sort]
    when, now = t[order][:early], t[order][early:]
    low, high = np.searchsorted(when, now - span, "left"), np.searchsorted(when, now, "left")
    own = owner[edge:] - early
    left, right = np.searchsorted(where, codes[edge:] * early + low[own], "left"), np.searchsorted(where, codes[edge:] * early + high[own], "left")
    asked = np.zeros(len(words))
    codes = codes.astype(np.int32)
    same: dict[bytes, int] = {}  # the same words as often: one number
    kind = np.array([same.setdefault(codes[m].tobytes() + tf[m].tobytes(), len(same)) for m in map(slice, begins[:-1], begins[1:])], dtype=np.int64)
    copies = np.sort(kind[:early] * early + np.arange(early))
    found = (np.searchsorted(copies, kind[early:] * early + high) > np.searchsorted(copies, kind[early:] * early + low)).astype(np.float64)

    def read(lists: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
        who = np.unique(np.concatenate([posted[a[j] : b[j]] for j in lists]))
        entries, start = _entries(begins, who)
        return float(np.add.reduceat(asked[codes[entries]] * x[entries], start).max())

    for i in np.flatnonzero(found == 0).tolist():  # a copy's cosine is 1
        mine = slice(begins[early + i], begins[early + i + 1])
        a, b = left[mine.start - edge : mine.stop - edge], right[mine.start - edge : mine.stop - edge]
        size = b - a
        lists = np.argsort(size, kind="stable")
        lists = lists[np.searchsorted(size[lists], 1) :]
        if not len(lists):
            continue
        mx = x[mine]
        sums = np.cumsum(size[lists])
        whole = sums[-1] + high[i] - low[i]  # what adding up all lists takes; to read one text takes as much as some 50 postings
        asked[codes[mine]] = mx
        done = max(1, int(np.searchsorted(sums, 64, "right")))
        best, until = 0.0, len(lists)
        if cheap := 50 * sums[done - 1] < whole:
            rest = np.sqrt(np.cumsum((mx[lists] ** 2)[::-1])[::-1])  # of the lists from each one on
            best = read(lists[:done], a, b)
            until = done + int(np.searchsorted(-rest[done:], -best, "left"))
        if cheap and until > done and 50 * (sums[until - 1] - sums[done - 1]) < whole:
            best = max(best, read(lists[done:until], a, b))
        elif until > done or not cheap:
            total = np.zeros(high[i] - low[i])
            for j in lists:
                total[posted[a[j] : b[j]] - low[i]] += mx[j] * y[a[j] : b[j]]
            best = float(total.max())
        asked[codes[mine]] = 0.0
        found[i] = best
    ids = rows.column("id").take(pa.array(order[early:]))
    return pa.table({"id": ids, "s": pa.array(found)}).filter(pa.array(found > 0))
