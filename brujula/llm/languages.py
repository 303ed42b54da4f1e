"""Language of each text and of each stretch of a mixed text (problem 1).

Every language has probabilities for the pieces of a fixed public vocabulary. The score of
a word in a language is its probability summed over all its segmentations into pieces
(forward algorithm, all words of a batch and all languages together); the piece
probabilities are fitted by expectation maximisation on a bounded sample of labelled rows
(`per_language` rows each, the only bound; everything else covers all rows). A text is a
chain of words with a cost for changing the language, lower after punctuation; the best
chain gives the stretches, and forward-backward sums give each stretch its confidence.

Defined cases: a null text gives no row; so does one without any letter; repeated rows are
labelled each; ties go to the language named first; texts of any length are read whole;
an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brujula.session import spread

LANGUAGES = ("es", "en", "pt", "fr", "de", "it")

#: Names and codes of the languages in their usual spellings, folded (fixed values).
NAMES = {
    "es": "es spa esp espanol castellano spanish espagnol spagnolo spanisch espanhol esl",
    "en": "en eng ingles english anglais englisch inglese ing",
    "pt": "pt por portugues portuguese portugais portugiesisch portoghese ptb",
    "fr": "fr fra fre frances francais french franzosisch francese",
    "de": "de deu ger aleman deutsch german allemand alemao tedesco",
    "it": "it ita italiano italian italien italienisch",
}
_NAMES = {name: code for code, names in NAMES.items() for name in names.split()}
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 40  # letters up to which words are scored many at once and enter the fit; longer ones are scored one by one
UNKNOWN = 1e-7
CELLS = 60_000  # words of the texts that are labelled together, with padding
CHANGE, CHANGE_AT_SIGN = 11.0, 6.5


def label_code(label: str | None) -> str | None:
    """Code of the language that a label names in any spelling; None if it names none of the six."""
    if label is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", label.strip().lower()) if not unicodedata.combining(c))
    if plain in _NAMES:
        return _NAMES[plain]
    m = re.fullmatch(r"([a-z]{2,3})[-_][a-z0-9]{2,8}(?:[-_][a-z0-9]+)*", plain)
    return _NAMES.get(m[1]) if m else None


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters of the public vocabulary, a leading sign for a word's start kept as ' '."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i).replace("▁", " ")
        body = piece.lstrip(" ")
        if body and body == body.lower() and all(c.isalpha() for c in body) and piece.count(" ") <= 1 and len(piece) <= 16:
            out.add(piece)
    return sorted(out)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of code points."""
    h = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            h = (h + codes[:, j].astype(np.uint64) + np.uint64(1)) * _MULT
            h ^= h >> np.uint64(29)
    return h


class Pieces:
    """Finds which pieces occur where in many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for n, ids in by_length.items():
            codes = np.array([[ord(c) for c in pieces[i]] for i in ids], dtype=np.uint32)
            h = _hashes(codes)
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array(ids)[order])

    def matches(self, words: list[str]):
        """(length of the longest word + 1, {(end, n): (word indices, piece ids)}); a word starts with ' '."""
        padded = [" " + w for w in words]
        width = max(map(len, padded))
        codes = np.array(padded, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
        lengths = np.array([len(w) for w in padded])
        found = {}
        with np.errstate(over="ignore"):
            for start in range(width):
                h = np.zeros(len(words), dtype=np.uint64)
                alive = np.arange(len(words))
                for n in range(1, min(16, width - start) + 1):
                    ok = lengths[alive] >= start + n
                    if not ok.all():
                        alive, h = alive[ok], h[ok]
                    if not len(alive):
                        break
                    h = (h + codes[alive, start + n - 1].astype(np.uint64) + np.uint64(1)) * _MULT
                    h ^= h >> np.uint64(29)
                    if n in self.tables:
                        keys, ids = self.tables[n]
                        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        hit = keys[at] == h
                        if hit.any():
                            found[(start + n, n)] = (alive[hit], ids[at[hit]])
        return lengths, width, found


def forward(found: dict, n_words: int, width: int, p: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: probability of all segmentations up to the position."""
    alpha = np.zeros((width + 1, n_words, p.shape[1]))
    alpha[0] = 1.0
    for end in range(1, width + 1):
        a = alpha[end]
        if end == 1:
            a += UNKNOWN**0.5  # the sign of the word's start by itself
        else:
            a += alpha[end - 1] * UNKNOWN
        for n in range(1, min(16, end) + 1):
            m = found.get((end, n))
            if m is not None:
                w, ids = m
                a[w] += alpha[end - n][w] * p[ids]
    return alpha


def word_scores(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    if not words:
        return np.zeros((0, p.shape[1]))
    out = np.zeros((len(words), p.shape[1]))
    sizes = np.array([len(x) for x in words])
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        out[i] = long_word_score(pieces, p, words[i])
    short = np.flatnonzero(sizes <= LONGEST)
    order = short[np.argsort(sizes[short], kind="stable")]
    for block in np.array_split(order, max(1, len(order) // 20_000)):
        if not len(block):
            continue
        lengths, width, found = pieces.matches([words[i] for i in block])
        alpha = forward(found, len(block), width, p)
        out[block] = np.log(alpha[lengths, np.arange(len(block))])
    return out


def long_word_score(pieces: Pieces, p: np.ndarray, word: str) -> np.ndarray:
    """Log probability of a word of any length in each language: the same sums as `forward`, position by position
    and scaled on the way, since the probability of a long word is smaller than any number."""
    codes = np.array([ord(c) for c in " " + word], dtype=np.uint64)
    size = len(codes)
    h = np.zeros(size, dtype=np.uint64)
    at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    with np.errstate(over="ignore"):
        for n in range(1, min(16, size) + 1):
            h = h[: size - n + 1]
            h = (h + codes[n - 1 :] + np.uint64(1)) * _MULT
            h ^= h >> np.uint64(29)
            if n in pieces.tables:
                keys, ids = pieces.tables[n]
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for start in np.flatnonzero(keys[k] == h).tolist():
                    at[start + n].append((n, int(ids[k[start]])))
    alpha = np.zeros((size + 1, p.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros(p.shape[1])
    for end in range(1, size + 1):
        a = alpha[end]
        a += UNKNOWN**0.5 if end == 1 else alpha[end - 1] * UNKNOWN
        for n, i in at[end]:
            a += alpha[end - n] * p[i]
        small = a < 1e-100
        if small.any():
            alpha[max(0, end - 15) : end + 1, small] *= 1e100
            scale[small] -= np.log(1e100)
    return np.log(alpha[size]) + scale


def fit(pieces: Pieces, counts: dict[str, np.ndarray], rounds: int = 3, mixed: float = 0.05) -> np.ndarray:
    """Piece probabilities (pieces x languages) by expectation maximisation.

    counts: word -> how often it occurs in the sample of each language. `mixed` is the share
    of the piece distribution of all languages together in each language's own.
    """
    words = [w for w in sorted(counts) if len(w) <= LONGEST]
    k = len(LANGUAGES)
    v = len(pieces.pieces)
    lengths_of = np.array([len(x) for x in pieces.pieces])
    p = np.repeat((0.02 ** np.minimum(lengths_of, 4))[:, None], k, axis=1)
    p /= p.sum(axis=0)
    if not words:
        return p
    c = np.array([counts[w] for w in words], dtype=float)
    lengths, width, found = pieces.matches(words)
    n = len(words)
    for _ in range(rounds):
        alpha = forward(found, n, width, p)
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(n)] = 1.0
        total = alpha[lengths, np.arange(n)]
        expected = np.zeros((v, k))
        scale = c / total
        for end in range(width, 0, -1):
            beta[end - 1] += beta[end] * (UNKNOWN**0.5 if end == 1 else UNKNOWN)
            for m in range(1, min(16, end) + 1):
                hit = found.get((end, m))
                if hit is None:
                    continue
                w, ids = hit
                flow = beta[end][w] * p[ids]
                np.add.at(expected, ids, flow * alpha[end - m][w] * scale[w])
                beta[end - m][w] += flow
        own = expected / np.maximum(expected.sum(axis=0), 1e-9)
        floor = np.where(lengths_of <= 2, 1e-6, 1e-8)[:, None]
        shared = own.mean(axis=1, keepdims=True) + floor
        p = (1 - mixed) * own + mixed * shared / shared.sum()
        p /= p.sum(axis=0)
    return p


class Labeller:
    """Finds the stretches of texts; keeps the scores of the words of a partition."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.code: dict[str, int] = {}
        self.scores = np.zeros((0, p.shape[1]))

    def _codes(self, lists: list[list[str]]) -> np.ndarray:
        if len(self.code) > 1_000_000:
            self.code, self.scores = {}, np.zeros((0, self.p.shape[1]))
        fresh: list[str] = []
        for ws in lists:
            for w in ws:
                if w not in self.code:
                    self.code[w] = len(self.code)
                    fresh.append(w)
        if fresh:
            self.scores = np.vstack([self.scores, word_scores(self.pieces, self.p, fresh)])
        return np.fromiter((self.code[w] for ws in lists for w in ws), dtype=np.int64)

    def stretches(self, texts: list[str | None], confidence: bool = False) -> list[list[tuple[int, int, int, float]]]:
        """Of each text: (language, start, end in characters, confidence) of its stretches in order."""
        spans = [[(m.start(), m.end()) for m in WORD.finditer(t)] if t else [] for t in texts]
        lists = [[t[a:b].lower() for a, b in s] if t else [] for t, s in zip(texts, spans)]
        codes = self._codes(lists)
        sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
        starts = np.append(0, np.cumsum(sizes))
        sign = np.zeros(len(codes), dtype=bool)
        k = 0
        for t, s in zip(texts, spans):
            end = 0
            for a, b in s:
                sign[k] = a - end > 1 and not t[end:a].isspace()
                end = b
                k += 1
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        some = np.flatnonzero(sizes)
        order = some[np.argsort(sizes[some], kind="stable")]
        first = 0
        for i in range(1, len(order) + 1):  # blocks of like sizes, bounded in cells so that long texts come few at a time
            if i == len(order) or (i + 1 - first) * sizes[order[i]] > CELLS:
                self._block(order[first:i], sizes, starts, codes, sign, spans, out, confidence)
                first = i
        return out

    def _block(self, block, sizes, starts, codes, sign, spans, out, confidence) -> None:
        n, width, k = len(block), int(sizes[block].max()), self.p.shape[1]
        at = np.minimum(starts[block][:, None] + np.arange(width), len(codes) - 1)
        inside = np.arange(width) < sizes[block][:, None]
        e = np.where(inside[:, :, None], self.scores[codes[at]], 0.0)
        e -= e.max(axis=2, keepdims=True)
        cost = np.where(sign[at], CHANGE_AT_SIGN, CHANGE)
        best = e[:, 0].copy()
        back = np.zeros((width, n, k), dtype=np.int8)
        rows = np.arange(n)
        for j in range(1, width):
            top = best.argmax(axis=1)
            jump = best[rows, top][:, None] - cost[:, j][:, None]
            move = jump > best
            back[j] = np.where(move, top[:, None], np.arange(k))
            step = np.where(move, jump, best) + e[:, j]
            best = np.where(inside[:, j][:, None], step, best)
            back[j] = np.where(inside[:, j][:, None], back[j], np.arange(k))
        state = best.argmax(axis=1)
        path = np.zeros((n, width), dtype=np.int8)
        for j in range(width - 1, -1, -1):
            path[:, j] = state
            state = back[j][rows, state]
        post = self._posterior(e, cost, inside) if confidence else None
        change = np.zeros((n, width), dtype=bool)
        change[:, 1:] = (path[:, 1:] != path[:, :-1]) & inside[:, 1:]
        for i, row in enumerate(block.tolist()):
            edges = [0, *np.flatnonzero(change[i]).tolist(), int(sizes[row])] if change[i].any() else [0, int(sizes[row])]
            s = spans[row]
            parts = []
            for a, b in zip(edges, edges[1:]):
                lang = int(path[i, a])
                parts.append((a, b, lang, float(post[i, a:b, lang].mean()) if confidence else 1.0))
            if len(parts) > 1 and confidence:
                parts = self._certain(parts, post[i])
            for a, b, lang, conf in parts:
                out[row].append((lang, s[a][0], s[b - 1][1], conf))

    def _certain(self, parts, post) -> list:
        """A stretch that is less likely than not joins the one beside it (names alone make no stretch)."""
        sure = [q for q in parts if q[3] >= 0.5] or [max(parts, key=lambda q: (q[3], -q[0]))]
        out = []
        for a, b, lang, conf in sure:
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], b, lang, 0.0)
            else:
                out.append((out[-1][1] if out else 0, b, lang, conf))
        out[-1] = (out[-1][0], parts[-1][1], out[-1][2], out[-1][3])
        return [(a, b, lang, float(post[a:b, lang].mean())) for a, b, lang, _ in out]

    def _posterior(self, e, cost, inside) -> np.ndarray:
        n, width, k = e.shape
        p = np.exp(e)
        f = np.zeros((n, width, k))
        f[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
        turn = np.exp(-cost)
        for j in range(1, width):
            x = f[:, j - 1]
            x = x * (1 - turn[:, j])[:, None] + (turn[:, j] / k)[:, None]
            x = x * p[:, j]
            f[:, j] = np.where(inside[:, j][:, None], x / x.sum(axis=1, keepdims=True), f[:, j - 1])
        b = np.full((n, k), 1.0 / k)
        out = np.zeros((n, width, k))
        for j in range(width - 1, -1, -1):
            post = f[:, j] * b
            out[:, j] = post / post.sum(axis=1, keepdims=True)
            x = b * p[:, j]
            t = turn[:, j][:, None]
            x = x * (1 - t) + t * x.mean(axis=1, keepdims=True)
            b = np.where(inside[:, j][:, None], x / x.sum(axis=1, keepdims=True), b)
        return out


def train(df: DataFrame, text: str, label: str, path: str, per_language: int = 3000) -> tuple[Pieces, np.ndarray]:
    """Piece probabilities from a bounded sample."""
    return fit_sample(sample(df, text, label, per_language), path)


def sample(df: DataFrame, text: str, label: str, per_language: int = 3000):
    """l, t (pandas) of about per_language rows of each language, taken by hash of the text.

    The label is only a hint here: it may be wrong for some rows, which the sample's
    majority outweighs. The rows are ranked in parts of each language, so that the limit per
    part is small enough for Spark to apply it before the shuffle: only the sample moves.
    """
    names = [(name, code) for name, code in _NAMES.items()]
    own = F.create_map(*[F.lit(x) for pair in names for x in pair])
    primary = F.regexp_extract(F.translate(F.lower(F.trim(label)), "áéíóúñçãêä", "aeiouncaea"), r"^([a-z]+)", 1)
    rows = df.select(F.col(text).alias("t"), own[primary].alias("l")).filter(F.col("l").isNotNull() & F.col("t").isNotNull())
    h = F.xxhash64("t")
    parts = max(1, -(-per_language // 500))
    w = Window.partitionBy("l", "part").orderBy(h, "t")
    ranked = rows.withColumn("part", F.pmod(h, F.lit(parts))).withColumn("r", F.row_number().over(w))
    return ranked.filter(F.col("r") <= -(-per_language // parts)).select("l", "t").toPandas()


def fit_sample(rows, path: str) -> tuple[Pieces, np.ndarray]:
    """Pieces and their probabilities from a sample of labelled texts."""
    counts: dict[str, np.ndarray] = {}
    for code, t in zip(rows["l"], rows["t"]):
        k = LANGUAGES.index(code)
        for word in WORD.findall(t.lower()):
            counts.setdefault(word, np.zeros(len(LANGUAGES)))[k] += 1
    if counts:  # languages of unequal samples weigh the same
        total = sum(counts.values())
        scale = total.max() / np.maximum(total, 1)
        counts = {w: c * scale for w, c in counts.items()}
    pieces = Pieces(vocabulary(path))
    return pieces, fit(pieces, counts)


def segments(df: DataFrame, model: tuple[Pieces, np.ndarray], key: str, text: str, label: str | None = None) -> DataFrame:
    """key, segmento (from 1), idioma, confianza, inicio, fin, caso.

    caso tells whether the row needs a label: its label names no language, or another one
    than the text's, or the text holds several. Without a label column every row does.
    """

    def run(batches):
        labeller = Labeller(*model)
        for b in batches:
            keys, texts = b.column(key), b.column(text).to_pylist()
            found = labeller.stretches(texts, confidence=True)
            codes = [label_code(x) for x in b.column(label).to_pylist()] if label else [None] * len(texts)
            n = np.array([len(s) for s in found])
            flat = [x for s in found for x in s]
            rows = np.repeat(np.arange(len(texts)), n)
            case = [len(s) > 1 or codes[i] != LANGUAGES[s[0][0]] for i, s in enumerate(found) for _ in s]
            number = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(rows)),
                    pa.array(number, type=pa.int32()),
                    pa.array([LANGUAGES[x[0]] for x in flat], type=pa.string()),
                    pa.array([round(x[3], 6) for x in flat], type=pa.float64()),
                    pa.array([x[1] for x in flat], type=pa.int32()),
                    pa.array([x[2] for x in flat], type=pa.int32()),
                    pa.array(case, type=pa.bool_()),
                ],
                names=[key, "segmento", "idioma", "confianza", "inicio", "fin", "caso"],
            )

    kind = df.schema[key].dataType.simpleString()
    cols = list(dict.fromkeys([key, text, *([label] if label else [])]))
    return spread(df.select(*cols), key).mapInArrow(run, f"`{key}` {kind}, segmento int, idioma string, confianza double, inicio int, fin int, caso boolean")
