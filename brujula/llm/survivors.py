"""One surviving record per group of duplicates, field by field, by token-level consensus (problem 6).

Every field has a `Policy`: the value, the weight of a row's vote, and, where a rule names the row
to be preferred (most trusted, most complete, earliest), its order. The row that comes first in
that order votes with as much as all rows of its group together, besides its own weight.

1. The distinct values of a group are drawn together with the summed weights of their rows.
2. They are aligned progressively, heaviest first, token by token into columns; a column holds
   the weight of each of its tokens.
3. Every column elects its heaviest token, or none if leaving it out weighs more.
4. The existing value with the fewest token edits to the elected text is given out, with the
   first row that has it.

Groups of any size: the values of a large group are dealt to tasks of at most about `CHUNK`
values. What a task passes on are its weighted columns, not an elected text; columns are aligned
with columns in the same way until the group has one list of them. No vote is lost or rounded.

Defined cases: rows without a group key are in no group; groups of less than `least` rows are
left out; a field without any usable value in a group is left out; an empty text is a value
without tokens; ties go to the heavier value, then to the smallest key; repeated rows weigh as
often as they occur; an empty table gives no row; further columns, also ones named like the
output, are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brujula.session import cut

CHUNK = 64


@dataclass(frozen=True)
class Policy:
    """value (null: the row doesn't vote), weight of a vote, and up to two sort keys (least first) of the preferred row."""

    value: Column
    weight: Column | float = 1.0
    order: tuple[Column, ...] = ()


_TOKEN = re.compile(r"\w+|[^\w\s]+")


def token_edits(a: list[str], b: list[str]) -> int:
    """Least number of tokens put in, taken out or replaced."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


class Columns:
    """Weighted token columns of aligned values; `seen` is the weight of all of them."""

    def __init__(self, columns: list[dict[str, float]], seen: float):
        self.columns, self.seen = columns, seen

    @classmethod
    def of(cls, value: str, weight: float) -> Columns:
        return cls([{t: weight} for t in _TOKEN.findall(value)], weight)

    def _full(self) -> np.ndarray:
        return np.array([sum(c.values()) for c in self.columns]) / self.seen if self.columns else np.zeros(0)

    def merged(self, other: Columns) -> Columns:
        """Both aligned: tokens that agree meet in a column, a column left out costs by how full it is."""
        one, two = self.columns, other.columns
        n, m = len(one), len(two)
        # shares of agreeing votes of each pair of columns, less what they must agree in to meet
        where: dict[str, list[tuple[int, float]]] = {}
        for b, c in enumerate(two):
            for t, w in c.items():
                where.setdefault(t, []).append((b, w / other.seen))
        fit = np.full((n, m), -0.5)
        for a, c in enumerate(one):
            for t, w in c.items():
                for b, v in where.get(t, ()):
                    fit[a, b] += 2 * (w / self.seen) * v
        skip_one, skip_two = (2 * self._full() - 1).tolist(), (2 * other._full() - 1).tolist()
        score = np.zeros((n + 1, m + 1))
        score[1:, 0], score[0, 1:] = -np.cumsum(skip_one), -np.cumsum(skip_two)
        table = score.tolist()
        for a in range(1, n + 1):
            row, above, f, g = table[a], table[a - 1], fit[a - 1].tolist(), skip_one[a - 1]
            for b in range(1, m + 1):
                row[b] = max(above[b - 1] + f[b - 1], above[b] - g, row[b - 1] - skip_two[b - 1])
        a, b, out = n, m, []
        while a or b:
            if a and b and table[a][b] == table[a - 1][b - 1] + float(fit[a - 1, b - 1]):
                a, b = a - 1, b - 1
                both = dict(one[a])
                for t, w in two[b].items():
                    both[t] = both.get(t, 0.0) + w
                out.append(both)
            elif a and (not b or table[a][b] == table[a - 1][b] - skip_one[a - 1]):
                a -= 1
                out.append(one[a])
            else:
                b -= 1
                out.append(two[b])
        return Columns(out[::-1], self.seen + other.seen)

    def elected(self) -> list[str]:
        out = []
        for c in self.columns:
            token, best = max(c.items(), key=lambda x: (x[1], x[0]))
            if best > self.seen - sum(c.values()):  # against leaving the column out
                out.append(token)
        return out

    def text(self) -> str:
        return json.dumps([self.seen, self.columns])

    @classmethod
    def read(cls, text: str) -> Columns:
        seen, columns = json.loads(text)
        return cls(columns, seen)


def aligned(parts: list[Columns]) -> Columns:
    """Progressive alignment, in the given order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.merged(p)
    return out


def _nearest(elected: list[str], values: list[str], weights: list[float], keys: list) -> tuple[int, int]:
    """(index, edits) of the value closest to the elected tokens."""
    edits = [token_edits(_TOKEN.findall(v), elected) for v in values]
    i = min(range(len(values)), key=lambda i: (edits[i], -weights[i], keys[i]))
    return i, edits[i]


def consensus(rows: DataFrame, group: str, key: str, policies: dict[str, Policy], least: int = 2) -> DataFrame:
    """group column, grupo (its smallest key), campo, key (first row with the chosen value), valor, distancia (token
    edits from the elected text), valores (distinct values of the group)."""
    gk, kk = rows.schema[group].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    sort = lambda p, i: (p.order[i] if i < len(p.order) else F.lit(0)).cast("bigint")
    votes = [
        F.struct(F.lit(name).alias("campo"), p.value.cast("string").alias("valor"), (p.weight if isinstance(p.weight, Column) else F.lit(p.weight)).cast("double").alias("w"), F.struct(sort(p, 0).alias("a"), sort(p, 1).alias("b"), F.col(key).alias("k")).alias("m"))
        for name, p in policies.items()
    ]
    own = cut(rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.array(*votes).alias("v")), "votes")
    groups = own.groupBy("g").agg(F.min("k").alias("grupo"), F.count("*").alias("filas")).filter(F.col("filas") >= least)
    long = own.join(groups, "g").select("g", "grupo", F.explode("v").alias("v")).select("g", "grupo", "v.*").filter("valor IS NOT NULL")
    values = cut(long.groupBy("g", "grupo", "campo", "valor").agg(F.sum("w").alias("peso"), F.min("m").alias("m")), "values")
    top = values.groupBy("g", "campo").agg(F.min("m").alias("primero"), F.sum("peso").alias("todo"), F.count("*").alias("valores"))
    ordered = F.col("campo").isin(*[n for n, p in policies.items() if p.order])
    values = values.join(top, ["g", "campo"]).withColumn("peso", F.col("peso") + F.when(ordered & (F.col("m") == F.col("primero")), F.col("todo")).otherwise(0.0))
    values = values.select("g", "grupo", "campo", "valor", "peso", F.col("m.k").alias("k"), "valores", F.ceil(F.col("valores") / CHUNK).cast("int").alias("trozos"))
    out = f"g {gk}, grupo {kk}, campo string, k {kk}, valor string, distancia int, valores bigint"
    names = [x.split()[0] for x in out.split(", ")]

    def choose(batches):
        """Groups of one task's values: aligned, elected and chosen at once."""
        for b in batches:
            lists = b.column("entradas").to_pylist()
            chosen = []
            for entries in lists:
                entries.sort(key=lambda e: (-e["peso"], e["valor"]))
                texts, weights, keys = ([e[c] for e in entries] for c in ("valor", "peso", "k"))
                elected = aligned([Columns.of(v, w) for v, w in zip(texts, weights)]).elected() if len(entries) > 1 else _TOKEN.findall(texts[0])
                i, d = _nearest(elected, texts, weights, keys)
                chosen.append((keys[i], texts[i], d, len(entries)))
            types = [b.schema.field("grupo").type, pa.string(), pa.int32(), pa.int64()]
            arrays = [pa.array([c[i] for c in chosen], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("grupo"), b.column("campo"), *arrays], names=names)

    entries = F.collect_list(F.struct("valor", "peso", "k")).alias("entradas")
    small = values.filter("trozos = 1").groupBy("g", "grupo", "campo").agg(entries).mapInArrow(choose, out)
    large = values.filter("trozos > 1")
    if not large.isEmpty():
        small = small.unionByName(_chosen_of_large(cut(large, "large"), gk, kk, out))
    return small.select(F.col("g").alias(group), "grupo", "campo", F.col("k").alias(key), "valor", "distancia", "valores")


def _chosen_of_large(values: DataFrame, gk: str, kk: str, out: str) -> DataFrame:
    """Like `choose` for groups of many values: columns are aligned level by level, then every value is measured."""

    def align(batches):
        for b in batches:
            texts, weights = [], []
            for entries in b.column("entradas").to_pylist():
                parts = [Columns.read(e["valor"]) if e["columnas"] else Columns.of(e["valor"], e["peso"]) for e in sorted(entries, key=lambda e: (-e["peso"], e["valor"]))]
                c = aligned(parts)
                texts.append(c.text())
                weights.append(c.seen)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("g", "campo", "trozos")], pa.array(texts, type=pa.string()), pa.array(weights, type=pa.float64())], names=["g", "campo", "trozos", "valor", "peso"])

    level, columns = values.select("g", "campo", "valor", "peso", "trozos"), False
    while True:
        own = F.collect_list(F.struct("valor", "peso", F.lit(columns).alias("columnas"))).alias("entradas")
        dealt = level.groupBy("g", "campo", "trozos", F.pmod(F.xxhash64("valor"), F.col("trozos")).cast("int").alias("t")).agg(own)
        level = cut(dealt.mapInArrow(align, f"g {gk}, campo string, trozos int, valor string, peso double"), "columns")
        columns = True
        if level.filter("trozos > 1").isEmpty():
            break
        level = level.withColumn("trozos", F.ceil(F.col("trozos") / CHUNK).cast("int"))

    def measure(batches):
        for b in batches:
            last, elected, d = None, [], []
            for v, t in zip(b.column("valor").to_pylist(), b.column("columnas").to_pylist()):
                if t != last:
                    last, elected = t, Columns.read(t).elected()
                d.append(token_edits(_TOKEN.findall(v), elected))
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("g", "grupo", "campo", "k", "valor", "peso", "valores")], pa.array(d, type=pa.int32())], names=["g", "grupo", "campo", "k", "valor", "peso", "valores", "d"])

    both = values.select("g", "grupo", "campo", "k", "valor", "peso", "valores").join(level.select("g", "campo", F.col("valor").alias("columnas")), ["g", "campo"])
    near = both.mapInArrow(measure, f"g {gk}, grupo {kk}, campo string, k {kk}, valor string, peso double, valores bigint, d int")
    best = near.groupBy("g", "grupo", "campo").agg(F.min(F.struct("d", (-F.col("peso")).alias("p"), "k", "valor")).alias("b"), F.max("valores").alias("valores"))
    return best.select("g", "grupo", "campo", "b.k", "b.valor", F.col("b.d").alias("distancia"), "valores")
