"""Sparse text vectors: TF-IDF weights, similarity joins, ranked search, novelty.

Vectors are long tables (key, w, x) of unit length per key, except where a row's terms
are needed together (a text's own terms, whose number the text bounds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brujula.functions.text import folded
from brujula.operators import postings
from brujula.session import cut, ship

#: Passages of a slice of the search and items of a part of the novelty, which have to fit a task.
SLICE = 200_000

#: Words that carry no content, folded (fixed values).
STOP = (
    "el", "la", "los", "las", "de", "del", "en", "y", "a", "que", "por", "con", "para", "un", "una", "se", "su", "al",
    "lo", "es", "cual", "como", "cuantos", "cuantas", "hay", "sobre", "cuanto", "cuanta", "cuales", "donde", "cuando",
    "quien", "quienes", "pasa", "paso", "sabe", "dijo", "dice", "dicen", "reporta", "reportan", "anuncio", "decidio",
    "hubo", "tendra", "tuvo", "fue", "son", "esta", "estan", "ya", "actual", "entre", "tras",
)


#: Stems that say nothing about an event (fixed values).
CLUSTER_STOP = (
    "panam", "no", "mas", "sus", "pero", "sin", "ante", "desde", "hasta", "segun", "este", "esta",
    "como", "sobre", "the", "of", "and", "in", "to", "for", "on", "at", "by", "with", "from", "as",
    "is", "are", "was", "its", "it", "an", "be", "has", "have", "after", "over", "new", "says",
    "der", "die", "das", "und", "auf", "den", "dem", "mit", "von", "fur", "im", "ist", "ein", "eine",
    "do", "da", "dos", "em", "na", "os", "um", "uma", "com",
)


def stems(col: Column) -> Column:
    """Content words: folded, without stop words and single signs, cut to five letters; numbers whole."""
    joined = F.when(F.contains(col, F.lit("&")), F.regexp_replace(col, r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_])\s*&\s*([\p{L}\p{N}_])(?![\p{L}\p{N}_])", "$1$2")).otherwise(col)  # most texts have none and aren't searched
    raw = F.regexp_extract_all(folded(joined), F.lit(r"([\p{L}\p{N}]+)"), 1)
    kept = F.filter(raw, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP))
    return F.transform(kept, lambda w: F.when(F.substring(w, 1, 1).rlike("[0-9]"), w).otherwise(F.substring(w, 1, 5)))


def content_stems(col: Column) -> Column:
    return F.filter(stems(col), lambda w: ~F.substring(w, 1, 1).rlike("[0-9]"))


def event_stems(col: Column) -> Column:
    """Distinct content stems that can tie two texts to one event."""
    return F.array_distinct(F.filter(content_stems(col), lambda w: ~w.isin(*CLUSTER_STOP)))


def plain_terms(col: Column) -> Column:
    """Folded words of two letters or digits or more."""
    return F.regexp_extract_all(folded(col), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def idf(docs: DataFrame, key: str, term: str = "w") -> DataFrame:
    """w, idf = ln((1+n)/(1+df)) + 1 over the keys of a term-count table."""
    n = docs.select(key).distinct().agg(F.count("*").alias("n"))
    df = docs.groupBy(term).agg(F.count("*").alias("df"))
    return df.crossJoin(n).select(term, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, w, tf."""
    return df.select(key, F.explode(terms).alias("w")).groupBy(key, "w").agg(F.count("*").alias("tf"))


def unit_vectors(counts: DataFrame, key: str, weights: DataFrame, sublinear: bool = False) -> DataFrame:
    """key, w, x with the squares of each key's x adding up to 1; terms without a weight drop out."""
    tf = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    v = counts.join(weights, "w").select(key, "w", (tf * F.col("idf")).alias("v"))
    norms = v.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return v.join(norms, key).select(key, "w", (F.col("v") / F.col("norm")).alias("x"))


def similar_pairs(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """a < b, sim of all keys whose unit vectors have a dot product of at least threshold.

    Exact. Terms are ordered by rarity; a pair's rarest common term lies where the rest of
    both vectors, from it on, still has a norm of threshold or more, so only the terms of that
    head are posted. For thresholds near 1 that are one or two rare terms of each text. Keys of
    equal vectors should be one key (`text_classes`).
    """
    rows = _with_heads(vectors, key, threshold)
    posted = rows.select(F.col(key).alias("k"), F.explode("h").alias("w"))
    pairs = posted.select(F.col("k").alias("a"), "w").join(posted.select(F.col("k").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()
    return _dots(pairs, rows, key).filter(F.col("sim") >= threshold - 1e-9)


def _with_heads(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, t (terms by rarity), h (the terms before which less than 1 - threshold^2 of the squared norm lies)."""
    rarity = vectors.groupBy("w").agg(F.count("*").alias("df"))
    rows = vectors.join(rarity, "w").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "w", "x"))).alias("t"))
    return cut(rows.withColumn("h", _head(threshold)), "heads")


def _head(threshold: float) -> Column:
    total = F.aggregate(F.col("t"), F.lit(0.0), lambda acc, e: acc + e.x * e.x)
    return F.aggregate(
        F.col("t"),
        F.struct(F.lit(0.0).alias("s"), F.array().cast("array<string>").alias("h")),
        lambda acc, e: F.struct((acc.s + e.x * e.x).alias("s"), F.when(F.sqrt(F.greatest(total - acc.s, F.lit(0.0))) >= threshold - 1e-9, F.concat(acc.h, F.array(e.w))).otherwise(acc.h).alias("h")),
    )["h"]


def _dots(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    left, right = rows.select(F.col(key).alias("a"), F.col("t").alias("ta")), rows.select(F.col(key).alias("b"), F.map_from_arrays(F.col("t.w"), F.col("t.x")).alias("mb"))
    dot = F.aggregate("ta", F.lit(0.0), lambda acc, e: acc + e.x * F.coalesce(F.element_at("mb", e.w), F.lit(0.0)))
    return pairs.join(left, "a").join(right, "b").select("a", "b", dot.alias("sim"))


def text_classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members: key, c; classes: c, texto, n): texts with the same terms, in any order, are one class."""
    own = cut(df.select(key, F.array_join(F.sort_array(plain_terms(F.col(text))), " ").alias("texto")).filter("texto <> ''").withColumn("c", F.xxhash64("texto")), "own")
    classes = cut(own.groupBy("c", "texto").agg(F.count("*").alias("n")), "classes")
    return own.select(key, "c"), classes


def _class_heads(classes: DataFrame, threshold: float) -> DataFrame:
    """c, t, h like `_with_heads`, of unit TF-IDF vectors of the classes, frequencies counted over all their members.

    A class's terms are counted inside its row, so the terms are joined with their weights once and drawn together once.
    """
    terms = F.split("texto", " ")
    counted = F.transform(F.array_distinct(terms), lambda w: F.struct(w.alias("w"), F.size(F.filter(terms, lambda x: x == w)).alias("tf")))
    long = classes.select("c", "n", F.explode(counted).alias("e")).select("c", "n", "e.*")
    total = classes.agg(F.sum("n").alias("all"))
    known = long.groupBy("w").agg(F.sum("n").alias("rows"), F.count("*").alias("df")).crossJoin(total)  # one row
    known = known.select("w", "df", (F.log((1 + F.col("all")) / (1 + F.col("rows"))) + 1).alias("idf"))
    raw = long.join(known, "w").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "w", (F.col("tf") * F.col("idf")).alias("v")))).alias("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda acc, e: acc + e.v * e.v))
    unit = raw.withColumn("norm", norm).select("c", F.transform("t", lambda e: F.struct(e.df.alias("df"), e.w.alias("w"), (e.v / F.col("norm")).alias("x"))).alias("t"))
    return cut(unit.withColumn("h", _head(threshold)), "heads")


def near_copies(df: DataFrame, key: str, text: str, when: str, threshold: float, hours: int, apart: str | None = None) -> DataFrame:
    """a < b, sim of the rows whose texts have a TF-IDF cosine of threshold or more, at most `hours` apart and, if
    `apart` is given, differing in that column.

    Texts with the same terms are one class, so a text that is sent a million times is compared once. Pairs of
    classes meet by a posted term and the time buckets that both have rows in; rows are joined last, by class and bucket.
    """
    members, classes = text_classes(df, key, text)
    span = hours * 3600 * 1_000_000
    dated = df.filter(F.col(when).isNotNull()).select(key, F.unix_micros(when).alias("t"), *([F.col(apart).alias("o")] if apart else []))
    rows = cut(members.join(dated, key).withColumn("g", F.floor(F.col("t") / span).cast("long")), "rows")
    heads = _class_heads(classes, threshold)
    places = rows.select("c", "g").distinct()
    posted = heads.select("c", F.explode("h").alias("w")).join(places, "c")
    one = posted.select(F.col("c").alias("a"), "w", F.explode(F.array("g", F.col("g") + 1, F.col("g") - 1)).alias("g"))
    pairs = one.join(posted.select(F.col("c").alias("b"), "w", "g"), ["w", "g"]).filter("a < b").select("a", "b").distinct()
    alike = cut(_dots(pairs, heads, "c").filter(F.col("sim") >= threshold - 1e-9), "alike")
    same = rows.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("sim"))
    extra = ["o"] if apart else []
    left = rows.select(F.col("c").alias("ca"), F.col(key).alias("ka"), F.col("t").alias("ta"), F.explode(F.array("g", F.col("g") + 1, F.col("g") - 1)).alias("g"), *[F.col(c).alias(c + "a") for c in extra])
    right = rows.select(F.col("c").alias("cb"), F.col(key).alias("kb"), F.col("t").alias("tb"), "g", *[F.col(c).alias(c + "b") for c in extra])
    both = alike.unionByName(same).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "sim").join(left, "ca").join(right, ["cb", "g"])
    both = both.filter((F.abs(F.col("ta") - F.col("tb")) <= span) & ((F.col("ca") != F.col("cb")) | (F.col("ka") < F.col("kb"))))
    if apart:
        both = both.filter("oa <> ob")
    return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "sim")


def _weights(texts: DataFrame) -> DataFrame:
    """w, idf over all texts (their content stems, column cs), texts without stems counted too."""
    n = texts.agg(F.count("*").alias("n"))
    df = texts.select(F.explode(F.array_distinct("cs")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return df.crossJoin(n).select("w", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


class Index:
    """Passages (pasaje, texto, reciente) with their stems, cut once, and the weights of all their content stems."""

    def __init__(self, passages: DataFrame):
        read = F.array(stems(F.col("texto")))  # inside the lambda the text is read once
        both = F.transform(read, lambda s: F.struct(F.array_distinct(s).alias("ps"), F.filter(s, lambda w: ~F.substring(w, 1, 1).rlike("[0-9]")).alias("cs")))[0]
        self.passages = cut(passages.select("pasaje", "reciente", both.alias("x")).select("pasaje", "reciente", "x.ps", "x.cs"), "passages")
        self.weights = cut(_weights(self.passages), "weights")

    def meeting(self, keys: DataFrame) -> DataFrame:
        """consulta, pasaje, reciente, ps, cs of the passages that hold one of a query's keys (consulta, w)."""
        posted = self.passages.select("pasaje", F.explode("ps").alias("w")).join(keys.select("w").distinct(), "w", "left_semi")
        return posted.join(keys, "w").select("consulta", "pasaje").distinct().join(self.passages, "pasaje")

    def asked(self, queries: DataFrame, k: int, least: float, coverage: float, boost: float) -> DataFrame:
        """consulta, pasaje, reciente, s: the k best passages in every slice for queries (consulta, ws stems, xs weights)."""
        spark = queries.sparkSession
        ship(spark)
        n, cores = self.passages.count(), spark.sparkContext.defaultParallelism
        slices = -(-n // (SLICE * cores)) * cores if n > 5000 * cores else max(1, n // 5000, -(-n // SLICE))  # whole rounds of tasks
        kind = {c: f.dataType for f in [*self.passages.schema, *queries.schema] for c in [f.name]}
        none = lambda c: F.lit(None).cast(kind[c]).alias(c)
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("parte")
        packed = self.weights.groupBy(F.pmod(F.xxhash64("w"), F.lit(256))).agg(F.collect_list(F.struct("w", "idf")).alias("e"))
        one = packed.select(everywhere, F.lit(0).alias("rol"), none("consulta"), none("pasaje"), none("reciente"), F.col("e.w").alias("ws"), none("cs"), F.col("e.idf").alias("xs"))
        two = self.passages.filter(F.size("ps") > 0).select(F.pmod(F.xxhash64("pasaje"), F.lit(slices)).cast("int").alias("parte"), F.lit(1).alias("rol"), none("consulta"), "pasaje", "reciente", F.col("ps").alias("ws"), "cs", none("xs"))
        three = queries.select(everywhere, F.lit(2).alias("rol"), "consulta", none("pasaje"), none("reciente"), "ws", none("cs"), "xs")
        rows = one.unionByName(two).unionByName(three).repartitionById(slices, F.col("parte")).sortWithinPartitions("rol")
        out = ", ".join(f"`{c}` {kind[c].simpleString()}" for c in ("consulta", "pasaje", "reciente")) + ", s double"
        return rows.mapInArrow(lambda batches: postings.search_slice(batches, k, least, coverage, boost), out)

    def scored(self, pairs: DataFrame, queries: DataFrame, boost: float) -> DataFrame:
        """pairs with s: cosine of sublinear TF-IDF vectors, plus a boost where the passage holds a year that the query names."""
        pairs = cut(pairs, "candidates")
        met = pairs.groupBy("pasaje").agg(F.first("cs").alias("cs"))
        p = unit_vectors(term_counts(met, "pasaje", F.col("cs")), "pasaje", self.weights, sublinear=True)
        q = unit_vectors(term_counts(queries, "consulta", content_stems(F.col("texto"))), "consulta", self.weights, sublinear=True)
        s = pairs.select("consulta", "pasaje").join(p.withColumnRenamed("x", "y"), "pasaje").join(q, ["consulta", "w"]).groupBy("consulta", "pasaje").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
        asked = queries.select("consulta", years(F.col("texto")).alias("qy"))
        out = pairs.join(s, ["consulta", "pasaje"], "left").join(asked, "consulta")
        return out.withColumn("s", F.coalesce("s", F.lit(0.0)) + F.when(F.arrays_overlap("qy", "ps"), boost).otherwise(0.0)).drop("qy", "cs")


def years(col: Column) -> Column:
    """Four-digit years of 1900 to 2099 that a text names."""
    return F.filter(stems(col), lambda w: w.rlike("^(19|20)[0-9]{2}$"))


def _best(good: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("consulta").orderBy(F.desc(F.round("s", 6)), F.desc_nulls_last("reciente"), "pasaje")
    return good.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= k).select("consulta", "pasaje", F.round("s", 4).alias("puntaje"), "puesto")


def ranked_search(queries: DataFrame, passages: DataFrame | Index, k: int = 10, least: float = 0.10, coverage: float = 0.5, boost: float = 0.15) -> DataFrame:
    """consulta, pasaje, puntaje, puesto: the k best passages of each query that pass the gates.

    queries: consulta, texto; passages: pasaje, texto, reciente. A passage must reach `least`
    and hold `coverage` of the query's distinct stems, numbers included. Ties go to the more
    recent, then smaller key. Every slice of the passages is asked all queries over its own lists of
    postings and gives its k best, so what is drawn together grows with the results only.
    """
    index = passages if isinstance(passages, Index) else Index(passages)
    asked = queries.select("consulta", "texto", F.array_distinct(stems(F.col("texto"))).alias("qs"))
    own = unit_vectors(term_counts(queries, "consulta", content_stems(F.col("texto"))), "consulta", index.weights, sublinear=True)
    stem = F.struct("w", F.coalesce("x", F.lit(0.0)).alias("x"))
    long = asked.select("consulta", F.explode("qs").alias("w")).join(own, ["consulta", "w"], "left").groupBy("consulta").agg(F.sort_array(F.collect_list(stem)).alias("e"))
    return _best(index.asked(cut(long.select("consulta", F.col("e.w").alias("ws"), F.col("e.x").alias("xs")), "asked"), k, least, coverage, boost), k)


def retried_search(queries: DataFrame, passages: DataFrame | Index, names: DataFrame, k: int = 10, least: float = 0.10, coverage: float = 0.5) -> DataFrame:
    """Like ranked_search; queries without a result are tried again with short and full names of what they name.

    names: corto, largo (a short list). In the second try the text gets the other form of each
    name, a name counts as one concept that either form covers, and all names must be covered.
    """
    index = passages if isinstance(passages, Index) else Index(passages)
    first = cut(ranked_search(queries, index, k, least, coverage), "first")
    rest = queries.join(first.select("consulta").distinct(), "consulta", "left_anti").withColumn("qs", F.array_distinct(stems(F.col("texto"))))
    forms = names.select("corto", "largo", F.array_distinct(stems(F.col("corto"))).alias("fc"), F.array_distinct(stems(F.col("largo"))).alias("fl"))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    named = rest.crossJoin(forms).filter(inside(F.col("fc"), F.col("qs")) | inside(F.col("fl"), F.col("qs")))  # names is a short list
    wider = named.groupBy("consulta").agg(
        F.first("texto").alias("texto"), F.first("qs").alias("qs"), F.array_sort(F.collect_list(F.struct("corto", "fc", "fl"))).alias("conceptos"),
        F.array_join(F.array_sort(F.collect_list(F.when(inside(F.col("fc"), F.col("qs")), F.col("largo")).otherwise(F.col("corto")))), " ").alias("mas"),
    ).withColumn("texto", F.concat_ws(" ", "texto", "mas"))
    wider = cut(wider, "wider")
    # a hit covers every name, so it holds all of a form of the first one
    keys = cut(wider.select("consulta", F.explode(F.array_distinct(F.concat(F.slice(F.col("conceptos")[0].fc, 1, 1), F.slice(F.col("conceptos")[0].fl, 1, 1)))).alias("w")), "keys")
    met = index.meeting(keys).join(wider.select("consulta", "qs", "conceptos"), "consulta")
    covered = F.filter("conceptos", lambda c: inside(c.fc, F.col("ps")) | inside(c.fl, F.col("ps")))
    own = F.array_except("qs", F.flatten(F.transform("conceptos", lambda c: F.concat(c.fc, c.fl))))
    share = F.size(covered) + F.size(F.array_intersect(own, "ps")) >= coverage * (F.size("conceptos") + F.size(own))
    good = met.filter((F.size(covered) == F.size("conceptos")) & share).drop("qs", "conceptos")
    return first.unionByName(_best(index.scored(good, wider.select("consulta", "texto"), 0.0).filter(F.col("s") >= least), k))


def group_keys(members: DataFrame, group: str, ident: str) -> DataFrame:
    """group, clave: the stable id of a group: its only id's own, else a digest of all its sorted ids."""
    ids = members.select(group, ident).distinct().groupBy(group).agg(F.sort_array(F.collect_list(ident)).alias("ids"))
    single = F.concat(F.lit("K-"), F.substring(F.col("ids")[0], 3, 100))
    return ids.select(group, F.when(F.size("ids") == 1, single).otherwise(F.concat(F.lit("K-"), F.substring(F.sha1(F.array_join("ids", "|")), 1, 10))).alias("clave"))


def evidence_in_order(hits: DataFrame, evidence: str) -> DataFrame:
    """consulta, evidence, orden: each query's distinct evidence in the order of its hits."""
    first = hits.groupBy("consulta", evidence).agg(F.min("puesto").alias("_p"))
    return first.select("consulta", evidence, F.row_number().over(Window.partitionBy("consulta").orderBy("_p")).alias("orden"))


def novelty(items: DataFrame, days: int = 7) -> DataFrame:
    """id, novedad = 1 - greatest cosine with items first seen before and within `days`; 1 without any.

    items: id, t (seconds, may be null), texto. Items meet by buckets of `days`; a bucket and those before it
    are dealt to parts of bounded size, in which cosines are added up in lists of postings, so no table of pairs is made.
    """
    span = days * 86400
    own = cut(items.select("id", "t", plain_terms(F.col("texto")).alias("ts")), "own")
    n = own.filter(F.size("ts") > 0).agg(F.count("*").alias("n"))
    df = own.select(F.explode(F.array_distinct("ts")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    weights = cut(df.crossJoin(n).select("w", F.monotonically_increasing_id().alias("k"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("e")), "weights")  # one row
    long = own.filter("id IS NOT NULL AND t IS NOT NULL").select("id", "t", F.explode("ts").alias("w")).join(weights, "w")
    dated = cut(long.groupBy("id", "t").agg(F.collect_list(F.struct("k", "e")).alias("l")).select("id", "t", F.floor(F.col("t") / span).cast("long").alias("b"), F.col("l.k").alias("ws"), F.col("l.e").alias("es")), "dated")
    sizes = dated.groupBy("b").agg(F.count("*").alias("n"))
    both = sizes.select("b", "n", F.lit(0).alias("m")).unionByName(sizes.select(F.col("b") + 1, F.lit(0), "n").toDF("b", "n", "m")).groupBy("b").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    parts = both.filter("n > 0").select("b", F.ceil(F.col("n") / SLICE).cast("int").alias("na"), F.ceil((F.col("n") + F.col("m")) / SLICE).cast("int").alias("np"))
    one = lambda many: F.pmod(F.xxhash64("id"), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    now = dated.join(parts, "b").select("*", one("na").alias("i"), each("np").alias("j"), F.lit(False).alias("past"))
    past = dated.withColumn("b", F.explode(F.array("b", F.col("b") + 1))).join(parts, "b").select("*", one("np").alias("j"), each("na").alias("i"), F.lit(True).alias("past"))
    cols = ["b", "i", "j", "id", "t", "past", "ws", "es"]
    ship(items.sparkSession)

    def run(rows):
        return postings.greatest_before(rows.select(["id", "t", "past", "ws", "es"]), span)

    near = now.select(cols).unionByName(past.select(cols)).groupBy("b", "i", "j").applyInArrow(run, f"id {items.schema['id'].dataType.simpleString()}, s double")
    best = near.groupBy("id").agg(F.max("s").alias("s"))
    fresh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("s", F.lit(0.0))))
    return own.select("id").join(best, "id", "left").select("id", F.round(fresh, 4).alias("novedad"))


def nearest_in_window(items: DataFrame, asked: DataFrame, seconds: int) -> DataFrame:
    """id, vecino, parecido: of each asked id (column id) the other item with the greatest cosine of TF-IDF vectors among those
    at most `seconds` away; ties to the smaller id; items that share no word with any have none.

    items: id, t (seconds, may be null), texto. Only the asked items' words are posted, by time bucket.
    """
    counts = term_counts(items, "id", plain_terms(F.col("texto")))
    v = unit_vectors(counts, "id", idf(counts, "id")).join(items.filter("t IS NOT NULL").select("id", "t"), "id").withColumn("b", F.floor(F.col("t") / seconds))
    own = v.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("t").alias("ta"), "w", "x", F.explode(F.array("b", F.col("b") - 1, F.col("b") + 1)).alias("b"))
    other = v.select(F.col("id").alias("o"), F.col("t").alias("to"), "w", F.col("x").alias("y"), "b")
    near = own.join(other, ["w", "b"]).filter((F.col("a") != F.col("o")) & (F.abs(F.col("ta") - F.col("to")) <= seconds))
    s = near.groupBy("a", "o").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("s")).filter("s > 0")
    best = s.groupBy("a").agg(F.max(F.struct("s", (-F.col("o")).alias("m"))).alias("x"))
    return best.select(F.col("a").alias("id"), (-F.col("x.m")).alias("vecino"), F.col("x.s").alias("parecido"))
