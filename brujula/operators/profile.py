"""Column-level data quality profile by character-class masks.

A value is generalised to a mask: runs of letters (w), single letters (a), runs of digits (9) and
of white space become one sign each, every other sign stays. A column's form may keep letters
that it turns on, and draw longer runs together (words of a slug to s, of a text to T). Masks are counted over all rows; those that
hold at least `min_share` of a column's values are its dominant patterns, every other mask is
rare. Of a column without a known form the rare masks are its violations. A column with a form
has an exact test: a dominant mask that proves its values (`Form.proof`) is good as a whole, and the cells of all other masks, rare ones and frequent bad ones alike, are tested one by
one. `min_share` thus decides how much is tested, not what is found. Loads are compared by
their figures and by the Jensen-Shannon divergence of their mask distributions.

Defined cases: null cells have no mask and are never violations; an empty table or load
gives no row; a load without a load numbered one lower gets no comparison; a load without
non-null values has no distinct ratio and no mean length, hence no such case; extra
columns are ignored; a column named like an output column is read before it is renamed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brujula.functions.text import folded, trimmed
from brujula.session import cut, spread

#: What UTF-8 text looks like once read as Latin-1 or Windows-1252, or once replaced.
MOJIBAKE = r"[ÂÃÅÐÑ][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â[\u0080-\u0082€‚][\u0080-\u00bf‘-”œžŸ¦™]|\ufffd|ï¿½"
MARKUP = r"</?[A-Za-z][^<>]*>|<!--|<!\[CDATA"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,10}[0-9]{0,2});"


#: White space of any kind.
SPACE = "[\\s\u00a0\u2007\u202f\u3000\ufeff]"
#: Letters that mis-decoded text is made of, and the private signs that stand for them while others are drawn together.
KEPT = "ÂÃÅÐÑâïƒŠŒŽšœžŸˆªµº"
PRIVATE = "".join(chr(0xE000 + i) for i in range(len(KEPT)))
_RUNS = ((r"\p{L}{2,}", "\x01"), (r"\p{L}", "a"), ("\x01", "w"), ("[0-9]+", "9"), (SPACE + "+", " "))


@dataclass(frozen=True)
class Form:
    """How a column's values become masks, and, where it is known, what their right form is.

    steps: rewritings in order, after trimming; keep: letters that stay as they are; test: whether a trimmed
    value has the right form; proof: a pattern of masks all of whose values have it.
    """

    steps: tuple[tuple[str, str], ...] = _RUNS
    keep: str = ""
    test: Callable[[Column], Column] | None = None
    proof: str = "$^"

    def mask(self, col: Column) -> Column:
        out = trimmed(col)
        if self.keep:
            out = F.translate(out, self.keep, PRIVATE)
        for pattern, sign in self.steps:
            out = F.regexp_replace(out, pattern, sign)
        return F.translate(out, PRIVATE, self.keep) if self.keep else out

    def right(self, col: Column) -> Column:
        """Whether a cell has the right form (null for null)."""
        return self.test(trimmed(col))


GENERIC = Form()

#: Folded texts that only stand for a missing one (fixed values).
STAND_INS = (
    "no description available", "no description", "description not available", "sin descripcion", "sin datos",
    "sin texto", "sin contenido", "sin resumen", "descripcion pendiente", "descripcion no disponible", "no disponible",
    "pendiente", "vacio", "n d", "n a", "nd", "na", "null", "none", "nan", "nil", "undefined", "tbd", "todo",
    "sem descricao", "sem dados", "descricao pendente", "indisponivel", "sans description", "non disponible",
    "aucune description", "keine beschreibung", "nicht verfugbar", "nessuna descrizione", "senza descrizione",
    "non disponibile", "lorem ipsum",
)


def _text_ok(col: Column) -> Column:
    plain = F.trim(F.regexp_replace(folded(col), r"[^\p{L}\p{N}]+", " "))
    return ~((plain == "") | plain.isin(*STAND_INS) | col.rlike(MARKUP) | col.rlike(ENTITY) | col.rlike(MOJIBAKE))


#: Identifiers: lower-case hex digits to h, everything else (but h itself) as it is.
HEX_ID = Form((("h", "x"), ("[0-9a-f]", "h")), test=lambda c: c.rlike("^N-[0-9a-f]{10}$"), proof="^N-h{10}$")

#: The sign of a web scheme at an address's start; in a value it is no sign.
WEB = "\u2713"
_REST = r"://(?=[^/?#\s]*\.)[^/?#\s]+(?:[/?#][^\s\u00a0]*)?$"

#: Addresses: words tied by dashes or underscores are one s.
ADDRESS = Form(
    ((WEB, "v"), ("^(?i:https?)://", WEB + "://"), *_RUNS, (r"[wa9]+(?:[-_]+[wa9]+)+", "s")),
    test=lambda c: c.rlike("^(?i:https?)" + _REST), proof="^" + WEB + _REST,
)

#: Running text: six words or more with ordinary punctuation are one T; signs of markup and entities stay.
TEXT = Form((*_RUNS, ("(?:[wa9][ ,.;:()%'\"«»“”‘’¿?¡!/…–—-]*){6,}", "T")), keep=KEPT, test=_text_ok, proof="^[ ,.;:()'\"«»“”‘’¿?¡!/…–—-]*T$")

NEWS_SPECS = {"id_noticia": HEX_ID, "url": ADDRESS, "descripcion": TEXT}


def cells(df: DataFrame, specs: dict[str, Form], keep: list[str]) -> DataFrame:
    """One row per non-null cell of the profiled columns: keep columns, columna, valor, mascara."""
    parts = []
    for name, spec in specs.items():
        value = F.col(name).cast("string")
        parts.append(F.struct(F.lit(name).alias("columna"), value.alias("valor"), spec.mask(value).alias("mascara")))
    rows = df.select(*dict.fromkeys([*keep, *specs]))
    return spread(rows, (keep or list(specs))[0]).select(*keep, F.explode(F.array(*parts)).alias("c")).select(*keep, "c.*").filter(F.col("valor").isNotNull())


def mask_counts(df: DataFrame, specs: dict[str, Form], by: list[str] | None = None) -> DataFrame:
    """Counts of each mask of each column (and load); pre-aggregated before the shuffle."""
    return cells(df, specs, by or []).groupBy(*(by or []), "columna", "mascara").agg(F.count("*").alias("n"))


def dominant_masks(counts: DataFrame, min_share: float) -> DataFrame:
    """columna, mascara of the patterns that hold at least min_share of a column's values."""
    totals = counts.groupBy("columna").agg(F.sum("n").alias("total"))
    return counts.join(totals, "columna").filter(F.col("n") >= min_share * F.col("total")).select("columna", "mascara")


def violations(df: DataFrame, specs: dict[str, Form], key: str, min_share: float = 0.01) -> DataFrame:
    """key, columna, mascara of the violations of each column (see the module).

    One pass works out each cell's mask and, where the mask proves nothing, the form's test; masks and verdicts are
    kept as a table. A column has at most 1/min_share dominant masks, so their list is bounded and enters the plan as literals.
    """
    names = list(specs)
    rows = df.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(names)])
    rows = spread(rows, "k").withColumns({f"m{i}": specs[c].mask(F.col(f"v{i}")) for i, c in enumerate(names)})

    def cell(i: int, c: str) -> Column:
        spec, m = specs[c], F.col(f"m{i}")
        right = F.when(m.rlike(spec.proof), True).otherwise(spec.right(F.col(f"v{i}"))) if spec.test else F.lit(None).cast("boolean")
        return F.struct(F.lit(c).alias("columna"), m.alias("mascara"), right.alias("correcta"))

    told = rows.select("k", F.explode(F.array(*[cell(i, c) for i, c in enumerate(names)])).alias("c")).select("k", "c.*").filter(F.col("mascara").isNotNull())
    told = cut(told, "masks")
    dominant = dominant_masks(told.groupBy("columna", "mascara").agg(F.count("*").alias("n")), min_share).collect()
    bad = F.lit(False)
    for c, spec in specs.items():
        own = [r["mascara"] for r in dominant if r["columna"] == c]
        known = F.col("mascara").isin(*own) if own else F.lit(False)
        if spec.test:  # a dominant mask that proves its values is good; all others go by their cells' test
            bad = bad | ((F.col("columna") == c) & ~(known & F.col("mascara").rlike(spec.proof)) & ~F.col("correcta"))
        else:
            bad = bad | ((F.col("columna") == c) & ~known)
    return told.filter(bad).select(F.col("k").alias(key), "columna", "mascara")


def load_figures(df: DataFrame, columns: list[str], load: str) -> DataFrame:
    """Per load and column: rows, non-null and distinct values, mean length in characters.

    Distinct values are counted exactly: cells are first drawn together by value hash (partial
    aggregation before the shuffle, so a value that fills a third of the table moves once
    per task), then the hashes are counted per load.
    """
    parts = [F.struct(F.lit(c).alias("columna"), F.xxhash64(F.col(c).cast("string")).alias("h"), F.length(F.col(c).cast("string")).cast("long").alias("largo")) for c in columns]
    long = df.select(F.col(load).alias("carga"), F.explode(F.array(*parts)).alias("c")).select("carga", "c.columna", F.when(F.col("c.largo").isNotNull(), F.col("c.h")).alias("h"), "c.largo")
    values = long.groupBy("carga", "columna", "h").agg(F.count("*").alias("n"), F.sum("largo").alias("largo"))
    some = F.col("h").isNotNull()
    return values.groupBy("carga", "columna").agg(
        F.sum("n").alias("filas"),
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("no_nulos"),
        F.count(F.when(some, 1)).alias("distintos"),
        F.sum("largo").alias("largo_total"),
    ).filter(F.col("carga").isNotNull()).withColumns(
        {
            "nulos": 1 - F.col("no_nulos") / F.col("filas"),
            "razon_distintos": F.try_divide(F.col("distintos"), F.col("no_nulos")),
            "longitud": F.try_divide(F.col("largo_total"), F.col("no_nulos")),
        }
    )


def load_shifts(figures: DataFrame, nulls: float = 0.1, distinct: float = 0.1, length: float = 0.2) -> DataFrame:
    """columna, problema, carga: the loads in which a figure moved away from the load numbered one lower."""
    before = figures.select((F.col("carga") + 1).cast(figures.schema["carga"].dataType).alias("carga"), "columna", *[F.col(c).alias(f"{c}_antes") for c in ("nulos", "razon_distintos", "longitud")])
    both = figures.join(before, ["carga", "columna"])
    moved = F.array_compact(
        F.array(
            F.when(F.abs(F.col("nulos") - F.col("nulos_antes")) > nulls, F.lit("nulos")),
            F.when(F.abs(F.col("razon_distintos") - F.col("razon_distintos_antes")) > distinct, F.lit("distintos")),
            F.when(F.abs(F.col("longitud") - F.col("longitud_antes")) > length * F.col("longitud_antes"), F.lit("longitud")),
        )
    )
    return both.select("columna", F.explode(moved).alias("problema"), "carga")


def mask_divergence(df: DataFrame, specs: dict[str, Form], load: str) -> DataFrame:
    """Jensen-Shannon divergence (base 2) between the mask distributions of each load and the one before.

    Columns: carga, columna, mascaras (distinct masks in the load), divergencia in [0, 1].
    """
    counts = mask_counts(df.filter(F.col(load).isNotNull()), specs, [load]).withColumnRenamed(load, "carga")
    totals = counts.groupBy("carga", "columna").agg(F.sum("n").alias("total"), F.count("*").alias("mascaras"))
    p = counts.join(totals, ["carga", "columna"]).select("carga", "columna", "mascara", (F.col("n") / F.col("total")).alias("p"))
    q = p.select((F.col("carga") + 1).cast(p.schema["carga"].dataType).alias("carga"), "columna", "mascara", F.col("p").alias("q"))
    both = p.join(q, ["carga", "columna", "mascara"], "full").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) / 2
    known = totals.join(totals.select((F.col("carga") + 1).cast(totals.schema["carga"].dataType).alias("carga"), "columna"), ["carga", "columna"])
    return (
        both.groupBy("carga", "columna")
        .agg(F.round(F.sum(half(F.col("p")) + half(F.col("q"))), 6).alias("divergencia"))
        .join(known.select("carga", "columna", "mascaras"), ["carga", "columna"])
        .select("carga", "columna", "mascaras", F.greatest("divergencia", F.lit(0.0)).alias("divergencia"))
    )


def column_profile(df: DataFrame, specs: dict[str, Form] | None = None) -> DataFrame:
    """One row per column of the table: rows, nulls, distinct values, least and greatest value (in the column's own
    order), lengths of the values as texts, and number and share of the masks that dominate.

    Ranges and lengths are one wide aggregate over the table; masks and distinct values come from the values drawn
    together per column, so that a mask is worked out once per distinct value.
    """
    names = df.columns
    text = lambda c: F.col(f"`{c}`").cast("string")
    wide = df.agg(
        F.count("*").alias("filas"),
        *[F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.min(f"`{c}`").cast("string").alias("a"), F.max(f"`{c}`").cast("string").alias("b"), F.min(F.length(text(c))).alias("x"), F.max(F.length(text(c))).alias("y"), F.round(F.avg(F.length(text(c))), 4).alias("z")).alias(f"f{i}") for i, c in enumerate(names)],
    )
    figures = wide.select("filas", F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(f"f{i}").alias("f")) for i, c in enumerate(names)])).alias("x"))
    figures = figures.filter("filas > 0").select("x.columna", "filas", (F.col("filas") - F.col("x.f.n")).alias("nulos"), F.col("x.f.a").alias("minimo"), F.col("x.f.b").alias("maximo"), F.col("x.f.x").alias("largo_minimo"), F.col("x.f.y").alias("largo_maximo"), F.col("x.f.z").alias("largo_medio"))
    rows = spread(df, names[0])
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), text(c).alias("valor")) for c in names])).alias("c")).select("c.*").filter(F.col("valor").isNotNull())
    own = GENERIC.mask(F.col("valor"))
    for c, spec in (specs or {}).items():
        own = F.when(F.col("columna") == c, spec.mask(F.col("valor"))).otherwise(own)
    masks = long.groupBy("columna", "valor").agg(F.count("*").alias("n")).groupBy("columna", own.alias("mascara")).agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    top = masks.groupBy("columna").agg(F.max(F.struct("n", "mascara")).alias("top"), F.count("*").alias("mascaras"), F.sum("n").alias("total"), F.sum("d").alias("distintos"))
    return figures.join(top, "columna", "left").select(
        *figures.columns, F.coalesce("distintos", F.lit(0)).alias("distintos"), "mascaras", F.col("top.mascara").alias("mascara_dominante"), F.round(F.col("top.n") / F.col("total"), 6).alias("parte_dominante")
    )
