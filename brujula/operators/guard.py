"""Checking a written answer (JSON) against the records that were given for it.

The answer has to be JSON of the agreed keys; it is blocked if it isn't, or if it gives away a
key or its instructions. Every citation must name a record that was given, a field of it and a
passage in that field. A claim stands if a citation does, none of them tries to give orders,
official data are told with year, country and unit and never as of today or as a forecast, quakes
only as quakes, and all its figures are in the records it cites. Accusations become attributed
statements. A draft goes if a claim fell, if it has figures that no record has, repeats an order
of a source or has the wrong length; it is marked where all it cites is a headline.

All of it is joins and column expressions: an answer is exploded to its citations, those are
joined to the records, and what is found is drawn together again per claim and answer.

Defined cases: null answers are blocked; an answer without claims keeps none; records without a
field are only missing it; repeated citations count as often as they are given; ties of faults go
to the first rule; an empty table gives an empty table; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brujula.operators import claims, figures
from brujula.session import cut

CITATION = "STRUCT<id_fuente: STRING, campo: STRING, pasaje: STRING>"
ANSWER = f"abstencion BOOLEAN, motivo_abstencion STRING, afirmaciones ARRAY<STRUCT<texto: STRING, tipo: STRING, citas: ARRAY<{CITATION}>>>, contradicciones ARRAY<STRUCT<version_a: STRING, cita_a: {CITATION}, version_b: STRING, cita_b: {CITATION}>>, borrador STRING, alertas ARRAY<STRING>, verificaciones_pendientes ARRAY<STRING>, preguntas_investigacion ARRAY<STRING>, titulo STRING, enfoque_interes_publico STRING"
KEYS = tuple(x.split(" ")[0] for x in ("abstencion motivo_abstencion afirmaciones contradicciones borrador alertas verificaciones_pendientes preguntas_investigacion titulo enfoque_interes_publico").split())
#: Marks of a record that is only a headline, and words of the answers' kinds (fixed values).
ONLY_HEADLINE = "Basado únicamente en titular/metadatos."
LENGTHS = {"brief": (1, 250), "guion": (110, 150), "copy": (1, 80), "respuesta": (1, 150)}


def unfenced(answer: Column) -> Column:
    """The text inside a fence of three backticks, or the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(answer), r"^```(?:json)?\s*([\s\S]*?)\s*```$", 1), F.lit("")), F.trim(answer))


def parsed(answer: Column) -> Column:
    """The answer as a struct; null where it isn't an object of the agreed keys and types."""
    text = unfenced(answer)
    keys = F.json_object_keys(text)
    strict = F.from_json(text, ANSWER + ", _malo STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malo"})
    known = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS]))) == 0)
    return F.when(known & strict["_malo"].isNull(), strict)


def official_fault(text: Column, kind: Column, fields: Column, year: Column) -> Column:
    """Why a claim on an official record is wrong, null if it isn't."""
    folded = claims.normalised(text)
    field = lambda n: F.coalesce(F.try_element_at(fields, F.lit(n)), F.lit(""))
    names = F.create_map(*[x for c, ns in claims.COUNTRIES.items() for x in (F.lit(c), F.array(*[F.lit(n) for n in ns]))])
    country, unit = field("pais_iso3"), field("unidad")
    named = F.coalesce(F.exists(F.try_element_at(names, country), lambda n: F.contains(folded, n)), F.lit(False)) | F.array_contains(F.split(folded, " "), F.lower(country))
    cell = (
        F.when(year.isNotNull() & ~F.contains(text, year.cast("string")), "dato sin año")
        .when(claims.flag(text, "hoy"), "dato anual como actual")
        .when(claims.flag(text, "pronostico"), "dato registrado como proyección")
        .when(~named, "dato sin país")
        .when(F.contains(unit, F.lit("%")) & ~F.contains(text, F.lit("%")) & ~F.contains(folded, F.lit("por ciento")), "dato sin unidad")
        .when(F.contains(claims.normalised(unit), F.lit("persona")) & ~folded.rlike("personas|habitantes"), "dato sin unidad")
    )
    return F.when(kind == "indicador", cell).when((kind == "sismo") & claims.flag(text, "sismico"), "sismo fuera de hechos sísmicos")


def incomparable(pairs: DataFrame) -> Column:
    """Whether two cited records (tipo_a, campos_a, anio_a, fecha_a and the same of b) can't contradict each other: an official
    cell only contradicts the same indicator, country and year, or news of its own year."""
    same = F.lit(True)
    for k in ("indicador_id", "pais_iso3", "anio"):
        same = same & F.try_element_at("campos_a", F.lit(k)).eqNullSafe(F.try_element_at("campos_b", F.lit(k)))
    cell_year, other = F.when(F.col("tipo_a") == "indicador", F.col("anio_a")).otherwise(F.col("anio_b")), F.when(F.col("tipo_a") == "indicador", F.col("tipo_b")).otherwise(F.col("tipo_a"))
    when = F.when(F.col("tipo_a") == "indicador", F.col("fecha_b")).otherwise(F.col("fecha_a"))
    own_year = F.coalesce((other == "noticia") & (F.year(when) == cell_year), F.lit(False))
    official = (F.col("tipo_a") == "indicador") | (F.col("tipo_b") == "indicador")
    return official & ~F.when((F.col("tipo_a") == "indicador") & (F.col("tipo_b") == "indicador"), same).otherwise(own_year)


def checked_claims(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """id, n (claim), texto, tipo, citas, citas_validas, motivo (null: it stands), cuerpo (texts of the cited records), solo_titular.

    answers: id, x (of `parsed`); evidence: id_fuente, tipo, campos (map), anio.
    """
    one = answers.select("id", F.posexplode("x.afirmaciones").alias("n", "a")).select("id", "n", F.coalesce("a.texto", F.lit("")).alias("texto"), F.col("a.tipo").alias("tipo"), "a.citas")
    cites = one.select("id", "n", "texto", F.posexplode("citas").alias("m", "c")).select("id", "n", "texto", "m", "c.*")
    e = evidence.select(F.col("id_fuente").alias("_id"), F.col("tipo").alias("_tipo"), "campos", "anio")
    joined = cites.join(e, F.col("id_fuente") == F.col("_id"), "left")
    text = F.try_element_at("campos", F.col("campo"))
    good = F.coalesce(F.contains(claims.normalised(text), claims.normalised(F.col("pasaje"))), F.lit(False))
    whole = F.array_join(F.map_values("campos"), " ")
    joined = joined.select(
        "id", "n", "m", good.alias("ok"), F.when(good, claims.flag(whole, "inyeccion")).alias("orden"), F.when(good, official_fault(F.col("texto"), F.col("_tipo"), F.col("campos"), F.col("anio"))).alias("falta"),
        F.when(good, whole).alias("cuerpo"), F.when(good, (F.col("_tipo") == "noticia") & F.try_element_at("campos", F.lit("descripcion")).isNull()).alias("titular"),
    )
    per = joined.groupBy("id", "n").agg(
        F.count("*").alias("citas_n"), F.count_if("ok").alias("citas_validas"), F.coalesce(F.bool_or("orden"), F.lit(False)).alias("orden"), F.min_by("falta", F.when(F.col("falta").isNotNull(), F.col("m"))).alias("falta"),
        F.array_join(F.collect_list("cuerpo"), " \n ").alias("cuerpo"), F.coalesce(F.bool_or("titular"), F.lit(False)).alias("solo_titular"),
    )
    out = one.drop("citas").join(per, ["id", "n"], "left").fillna(0, ["citas_n", "citas_validas"]).fillna(False, ["orden", "solo_titular"]).fillna("", ["cuerpo"])
    out = cut(out.withColumn("_l", figures.missing(F.col("texto"), F.col("cuerpo"))), "cited")
    lacking = F.col("_l")
    reason = (
        F.when(F.col("citas_validas") == 0, "sin cita válida")
        .when(F.col("orden"), "cita una fuente con órdenes")
        .when(F.col("falta").isNotNull(), F.col("falta"))
        .when(F.size(lacking) > 0, F.concat(F.lit("cifra sin respaldo: "), F.array_join(lacking, ", ")))
    )
    return out.select("id", "n", "texto", "tipo", F.col("citas_n").alias("citas"), "citas_validas", reason.alias("motivo"), "cuerpo", "solo_titular")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+(?:[-'’][\p{L}\p{N}_]+)*)"), 1))


def guard(answers: DataFrame, evidence: DataFrame, task: str = "brief") -> DataFrame:
    """id, bloqueada (why, null if it isn't), afirmaciones, afirmaciones_validas, citas, citas_validas, declaraciones (accusations that
    became statements), abstencion, borrador (null where it fell), faltas (joined by '; ').

    answers: id, salida (JSON); evidence: id_fuente, tipo ('noticia', 'indicador', 'sismo'), campos (map of texts), anio.
    """
    low, high = LENGTHS[task]
    read = answers.select("id", "salida", parsed(F.col("salida")).alias("x"))
    leak = F.when(claims.flag(F.col("salida"), "secreto"), "la salida contiene algo con forma de clave").when(claims.flag(F.col("salida"), "instrucciones"), "la salida reproduce sus instrucciones")
    blocked = F.when(F.col("x").isNull(), "salida inválida").otherwise(leak)
    read = cut(read.withColumn("bloqueada", blocked).drop("salida"), "answers")
    c = cut(checked_claims(read.filter("bloqueada IS NULL AND NOT coalesce(x.abstencion, false)"), evidence), "claims")
    stands = F.col("motivo").isNull()
    per = c.groupBy("id").agg(
        F.count("*").alias("afirmaciones"), F.count_if(stands).alias("afirmaciones_validas"), F.sum("citas").alias("citas"), F.sum("citas_validas").alias("citas_validas"),
        F.count_if(stands & (F.col("tipo") == "hecho") & claims.flag(F.col("texto"), "acusacion")).alias("declaraciones"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~stands, F.struct("n", "motivo")))), lambda r: r.motivo), "; ").alias("caidas"),
        F.array_join(F.collect_list(F.when(stands, F.col("cuerpo"))), " \n ").alias("cuerpo"), F.coalesce(F.bool_or(F.when(stands, F.col("solo_titular"))), F.lit(False)).alias("solo_titular"),
    )
    out = read.join(per, "id", "left").fillna(0, ["afirmaciones", "afirmaciones_validas", "citas", "citas_validas", "declaraciones"])
    out = cut(out.withColumn("_l", figures.missing(F.col("x.borrador"), F.col("cuerpo"))), "drafts")
    draft, lacking = F.col("x.borrador"), F.col("_l")
    marked = F.when(F.col("solo_titular") & ~F.contains(claims.normalised(draft), claims.normalised(F.lit(ONLY_HEADLINE[:-1]))), F.concat_ws(" ", F.lit(ONLY_HEADLINE), draft)).otherwise(draft)
    abstains = F.coalesce(F.col("x.abstencion"), F.lit(False)) | (F.col("afirmaciones_validas") == 0)
    fault = (
        F.when(F.col("bloqueada").isNotNull() | draft.isNull() | abstains, F.lit(None))
        .when(F.col("afirmaciones_validas") < F.col("afirmaciones"), "borrador descartado: puede contener afirmaciones sin sustento")
        .when(F.size(lacking) > 0, "borrador descartado: cifras sin respaldo")
        .when(claims.flag(draft, "inyeccion"), "borrador descartado: repite una orden")
        .when(~word_count(marked).between(low, high), "borrador descartado: largo")
    )
    empty = F.when(F.col("bloqueada").isNull() & F.coalesce(F.col("x.abstencion"), F.lit(False)) & (F.coalesce(F.col("x.motivo_abstencion"), F.lit("")) == ""), "abstención sin motivo")
    return out.withColumn("_falta", fault).select(
        "id", "bloqueada", "afirmaciones", "afirmaciones_validas", "citas", "citas_validas", "declaraciones", (F.col("bloqueada").isNotNull() | abstains).alias("abstencion"),
        F.when(F.col("bloqueada").isNull() & ~abstains & F.col("_falta").isNull(), marked).alias("borrador"), F.array_join(F.array_compact(F.array(F.nullif("caidas", F.lit("")), F.col("_falta"), empty)), "; ").alias("faltas"),
    )
