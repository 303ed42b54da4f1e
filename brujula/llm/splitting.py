"""Cutting oversized texts at natural boundaries (problem 9).

A text is parsed into a tree: sections by the level of their heading (marks, tags or numbered
parts of a law), blocks of markup, paragraphs, list items by their indentation, lines,
sentences, clauses, words. The tree is kept as the strength of the boundary before each word:
a node's children lie between the strongest boundaries inside it. Nodes within the limit stay
whole and neighbouring whole siblings are merged bottom-up while they fit; only oversized nodes
are entered, and what comes out of them is never merged with what lies beside them. What has
no boundary at all (one endless word) is cut between tokens at a character's edge.

A piece is its own part of the text preceded by the `overlap` tokens that come before it
in the document's encoding (a few more where that would cut a character). Its token count
is that of the piece's own text, encoded anew; a piece over the limit is an error.

Defined cases: null, empty and short texts give no row; repeated rows are split each; an
empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brujula.llm.bpe import Encoder
from brujula.session import spread

WORD, CLAUSE, SENTENCE, LINE = 1, 2, 3, 4
ITEM, DEEPEST = 8, 3  # a list item of depth 0, and the depth from which items are alike
PARAGRAPH, BLOCK = 9, 10
SECTION, LEVELS = 11, 6  # a heading of the sixth level; each level above it is one stronger
_HEADING = re.compile(r"(#{1,6})\s|<h([1-6])\b", re.IGNORECASE)
#: Words that number the parts of a law or book, by level (fixed values).
PARTS = {1: "t[ií]tulo|title|titel|titolo|titre", 2: "cap[ií]tulo|chapter|kapitel|capitolo|chapitre", 3: "secci[oó]n|se[cç][cç]?[aã]o|section|abschnitt|sezione", 4: "art[ií]culo|art[ií]go|article|artikel|articolo"}
_PART = re.compile("|".join(f"(?P<l{k}>{words})" for k, words in PARTS.items()) + "", re.IGNORECASE)
_NUMBER = re.compile(r"\s+(?:\d|[IVXLC]+\b)")
_ITEM = re.compile(r"(?:[-*•·–]|\d{1,3}[.)]|[a-zA-Z]\))\s")
_BLOCK = re.compile(r"<(?:(section|article|div|table|ul|ol|blockquote|pre)|(p)|(li|tr|dt|dd))\b", re.IGNORECASE)
_END = re.compile(r"[.!?…][\"'»”’)\]]*$")
_START = re.compile(r"\s*[\"'«“‘(¿¡—–-]*\s*[\dA-ZÀ-ÖØ-Þ]")
_SHORT = re.compile(r"(?:\b[A-ZÀ-Ö]|\b(?:[Ss]ra?|[Dd]ra?|[Ii]ng|[Ll]ic|[Aa]rq|[Pp]rof|[Nn]úm|[Nn]o|[Aa]rt|[Vv]ol|[Mm]r|[Mm]rs|[Ee]tc|[Pp]ág|[aAp]|B/))\.$")


_BREAKS = frozenset("\n\r")
_STOPS = frozenset(".!?…\"'»”’)]")
_CLAUSES = frozenset(";:—|")
_MARKS = _BREAKS | _STOPS | _CLAUSES | {">"}


def _of_start(start: str, breaks: int, indent: int) -> int:
    """Strength of a boundary after white space with line breaks, by what begins there."""
    if m := _HEADING.match(start):
        return SECTION + LEVELS - (len(m[1]) if m[1] else int(m[2]))
    if (m := _PART.match(start)) and _NUMBER.match(start, m.end()):
        return SECTION + LEVELS - int(m.lastgroup[1])
    if m := _BLOCK.match(start):
        return BLOCK if m[1] else PARAGRAPH if m[2] else ITEM
    if breaks > 1:
        return PARAGRAPH
    if _ITEM.match(start):
        return ITEM - min(indent // 2, DEEPEST)
    return LINE


def strengths(words: list[str]) -> np.ndarray:
    """Strength of the boundary before each word (0 before the first).

    Only the words after a mark (line break or sign of punctuation) are looked at more closely.
    """
    n = len(words)
    out = np.full(n, WORD, dtype=np.int8)
    if n:
        out[0] = 0
    for k in [k for k, w in enumerate(words) if w[-1] in _MARKS or (w[0] in _BREAKS)]:
        w = words[k]
        i = k + 1
        if i >= n:
            continue
        if w.isspace():
            if k and words[k - 1].isspace():
                continue  # the run's first word stands for it
            run = w
            while i < n and words[i].isspace():
                run += words[i]
                i += 1
            breaks = run.count("\n") + run.count("\r") - run.count("\r\n")
            if i < n and breaks:
                start = "".join(words[i : i + 8])
                bare = start.lstrip()
                tail = re.split(r"[\r\n]", run)[-1]
                out[i] = _of_start(bare, breaks, len(tail.expandtabs(4)) + len(start) - len(bare))
        elif words[i].isspace() and not _BREAKS.isdisjoint(words[i]):
            continue  # the boundary is after the break
        elif w[-1] == ">":
            if m := _BLOCK.match("".join(words[i : i + 4]).lstrip()):
                out[i] = BLOCK if m[1] else PARAGRAPH if m[2] else ITEM
            elif m := _HEADING.match("".join(words[i : i + 4]).lstrip()):
                out[i] = SECTION + LEVELS - (len(m[1]) if m[1] else int(m[2]))
        elif _END.search(w):
            if _START.match("".join(words[i : i + 2])) and not _SHORT.search("".join(words[max(0, i - 3) : i])):
                out[i] = SENTENCE
        elif w[-1] in _CLAUSES:
            out[i] = CLAUSE
    return out


def pack(tokens: np.ndarray, strength: np.ndarray, cap: int) -> list[tuple[int, int]]:
    """Word ranges that cover the text in order, each of at most cap tokens where words allow it: whole nodes of
    the tree, merged siblings, or the parts of an entered node."""
    total = np.append(0, np.cumsum(tokens))

    def node(a: int, b: int) -> list[tuple[int, int]]:
        if total[b] - total[a] <= cap or b - a == 1:
            return [(a, b)]
        inner = strength[a + 1 : b]
        cuts = np.flatnonzero(inner == inner.max()) + a + 1
        edges = [a, *cuts.tolist(), b]
        parts: list[tuple[int, int]] = []
        open_ = False  # whether the last part is made of whole siblings
        for x, y in zip(edges, edges[1:]):
            if total[y] - total[x] > cap and y - x > 1:
                parts += node(x, y)
                open_ = False
            elif open_ and total[y] - total[parts[-1][0]] <= cap:
                parts[-1] = (parts[-1][0], y)
            else:
                parts.append((x, y))
                open_ = True
        return parts

    return node(0, len(tokens)) if len(tokens) else []


def split_text(text: str, encoder: Encoder, limit: int, overlap: int, words: list[str] | None = None) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, overlap tokens, boundary) of each piece; start counts the overlap in characters of the text."""
    if words is None:
        (words,) = encoder.words([text])[2]
    codes = encoder.codes(words)
    tokens = encoder.lengths[codes]
    if int(tokens.sum()) <= limit:
        return []
    strength = strengths(words)
    # byte position of each token's start, and whether a character begins there
    raw = text.encode("utf-8", "surrogatepass")
    starts = np.append(0, np.cumsum(encoder.v.lengths[encoder.ids_of(codes)]))
    data = np.frombuffer(raw, dtype=np.uint8)
    begins = np.append((data & 0xC0) != 0x80, True)
    chars = np.append(0, np.cumsum(begins[:-1]))  # characters before each byte
    word_token = np.append(0, np.cumsum(tokens))
    word_char = np.append(0, np.cumsum([len(w) for w in words]))
    names = {0: "inicio", WORD: "palabra", CLAUSE: "frase", SENTENCE: "oracion", LINE: "linea", PARAGRAPH: "parrafo", BLOCK: "bloque"}
    names |= {s: "elemento" for s in range(ITEM - DEEPEST, ITEM + 1)} | {s: "seccion" for s in range(SECTION, SECTION + LEVELS)}

    def back(t: int) -> int:
        while t > 0 and not begins[starts[t]]:
            t -= 1
        return t

    def count(s: int, e: int) -> int:
        """Tokens of text[s:e] encoded anew: its words are those of the text but for a cut word at the
        start, with what it might draw in, and for white space at the end, which is drawn together there."""
        a, b = int(np.searchsorted(word_char, s)), int(np.searchsorted(word_char, e, side="right")) - 1
        if word_char[b] != e or b - a < 8:
            return int(encoder.counts([text[s:e]])[0])
        end = b
        while end > a + 3 and words[end - 1].isspace():
            end -= 1
        tail = int(encoder.counts([text[word_char[end] : e]])[0]) if end < b else 0
        if word_char[a] == s:
            return int(word_token[end] - word_token[a]) + tail
        (head,) = encoder.words([text[s : word_char[a + 3]]])[2]  # the rest of the cut word and three words more
        edges = s + np.cumsum([len(w) for w in head])
        if words[a + 2].isspace() or not set(edges[:-1].tolist()) & set(word_char[a : a + 3].tolist()):
            return int(encoder.counts([text[s:e]])[0])
        return int(encoder.lengths[encoder.codes(head)].sum() + word_token[end] - word_token[a + 3]) + tail

    for slack in range(0, limit // 2, 8):
        cap = limit - overlap - slack
        spans: list[tuple[int, int, str]] = []
        for a, b in pack(tokens, strength, cap):
            t, end = int(word_token[a]), int(word_token[b])
            kind = names[int(strength[a])]
            while end - t > cap:  # a word without any boundary inside
                u = back(t + cap)
                u = u if u > t else end
                spans.append((t, u, kind))
                t, kind = u, "caracter"
            spans.append((t, end, kind))
        pieces = []
        for t, end, kind in spans:
            s = back(max(0, t - overlap)) if t else 0
            pieces.append((int(chars[starts[s]]), int(chars[starts[end]]), t - s, kind))
        counts = [count(s, e) for s, e, _, _ in pieces]
        if max(counts) <= limit:
            break
    else:
        raise RuntimeError(f"no cut of a text of {len(text)} characters gives pieces of at most {limit} tokens")
    return [(s, e, int(n), o, kind) for (s, e, o, kind), n in zip(pieces, counts)]


def split_long(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64) -> DataFrame:
    """key, pieza (from 1), inicio, fin (characters), tokens, solape, corte, texto of every text over limit tokens."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")

    def run(batches):
        encoder = Encoder(path)
        for b in batches:
            texts = b.column(text).to_pylist()
            keys = b.column(key).to_pylist()
            codes, per_text, words = encoder.words(texts)
            ends = np.append(0, np.cumsum(encoder.lengths[codes]))[np.append(0, np.cumsum(per_text))]
            for i in np.flatnonzero(np.diff(ends) > limit).tolist():
                t = texts[i]
                rows = split_text(t, encoder, limit, overlap, words[i])
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i]] * n, type=b.schema.field(key).type),
                        pa.array(range(1, n + 1), type=pa.int32()),
                        *[pa.array([r[k] for r in rows], type=pa.int32()) for k in range(4)],
                        pa.array([r[4] for r in rows], type=pa.string()),
                        pa.array([t[r[0] : r[1]] for r in rows], type=pa.string()),
                    ],
                    names=[key, "pieza", "inicio", "fin", "tokens", "solape", "corte", "texto"],
                )

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, pieza int, inicio int, fin int, tokens int, solape int, corte string, texto string")
