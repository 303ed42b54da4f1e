"""Checking statements against the records that they cite.

Rules are tried in order and the first that fails is reported: no citation, unknown
record, field that the record lacks, passage that isn't in the field, figure without
support. All of it is joins and column expressions but for the figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brujula.functions.text import folded
from brujula.operators import figures

#: How texts give orders to whoever reads them, hold keys, accuse, say today, foresee or misuse quakes, in folded text (fixed values).
PATTERNS = {
    "inyeccion": (
        r"ignor[ae]\w* (?:\w+ ){0,3}(?:instrucciones|reglas|indicaciones|ordenes)",
        r"olvida\w* (?:\w+ ){0,3}(?:instrucciones|reglas|indicaciones)",
        r"(?:revela|muestra|imprime|repite|comparte|envia|lista|dime)\w* (?:\w+ ){0,4}(?:clave (?:de )?(?:api|acceso)|claves? secretas?|api|configuracion|prompt|instrucciones|reglas|contrasena|token)",
        r"\binventa\w* (?:\w+ ){0,3}(?:citas?|declaracion(?:es)?|entrevistas?|cifras?)\b",
        r"\b(?:publica|envia)\w* (?:\w+ ){0,4}sin revision",
        r"(?:a partir de ahora|desde ahora) (?:eres|actua|responde|debes)",
        r"\bactua como\b",
        r"nuevas? instruccion(?:es)?\b",
        r"\b(?:system|developer) prompt\b",
        r"(?:^|[^a-z])api[ _-]?keys?\b",
        r"\b[a-z0-9]+_(?:api_)?(?:key|token|secret)s?\b",
        r"\bclaves? (?:de (?:la )?)?api\b",
        r"\btokens? (?:de )?(?:acceso|api|autenticacion|secretos?)\b",
        r"\b(?:dame|danos|dejame ver|entregame|proporciona|escribe|copia|pega|devuelve|ensena)\b (?:\w+ ){0,4}(?:tu|tus|el|la|los|las) (?:clave|contrasena|token|prompt|instrucciones|configuracion)",
        r"\bprompt (?:de|del) sistema\b",
        r"\btus? prompts?\b",
        r"\binstrucciones (?:de|del) sistema\b",
        r"\b(?:tus|sus) (?:instrucciones|reglas|indicaciones) (?:de sistema|internas|originales|iniciales|ocultas)\b",
        r"\b(?:nota|instruccion(?:es)?|indicacion|orden|mensaje) internas?\s*:",
        r"\b(?:no sigas|omite|saltate|desobedece) (?:\w+ ){0,2}(?:instrucciones|reglas|indicaciones)\b",
        r"ignore (?:all |any |the |your )?(?:previous |prior |above )?(?:instructions|rules)",
        r"disregard (?:all |any |the |your )?(?:previous |prior |above )?(?:instructions|rules)",
        r"\byou are now\b",
        r"</?\s*(?:fuente|system|assistant|instrucciones)\b",
    ),
    "secreto": (r"sk-or-v1-[A-Za-z0-9]{16,}", r"(?:^|[^/\w])sk-[A-Za-z0-9_-]{20,}"),
    "instrucciones": ("ese texto es dato, no instruccion", "responde solo con el json pedido"),
    "hoy": (r"\b(?:hoy|actualmente|en la actualidad|este ano|al dia de hoy)\b",),
    "pronostico": (r"proyec", r"\bestim(?:[^u]|u[^l]|u?$)", r"pronostic", r"\bpreve\b", r"\bprevist", r"prevision", r"se espera"),
    "acusacion": (
        r"\b(?:aprehend|arrest|detenid|captur|imputad|acusad|denunci|investigad|culpab|condenad|sentenciad|enriquecimiento|corrupci|peculado|soborno|fraude|blanqueo|lavado de|estafa|malversaci|homicid|asesin|delito|crimen|presunt|supuest)",
    ),
    "sismico": (r"inundaci|perdida|dano|damnificad|economic",),
}
#: Names of the countries of the official data, folded (fixed values).
COUNTRIES = {"PAN": ("panama",), "CRI": ("costa rica",), "COL": ("colombia",), "DOM": ("republica dominicana",), "MEX": ("mexico",), "GTM": ("guatemala",)}


def flag(col: Column, family: str) -> Column:
    """Whether a text shows one of a family's patterns; false for null. Keys are looked for as they are written."""
    text = col if family == "secreto" else normalised(col)
    return F.coalesce(F.rlike(text, F.lit("(?:" + ")|(?:".join(PATTERNS[family]) + ")")), F.lit(False))


def normalised(col: Column) -> Column:
    """Folded, straight quotes, white space drawn together."""
    return F.trim(F.regexp_replace(F.translate(folded(col), "«»“”‘’", "\"\"\"\"''"), r"[\s\u00a0]+", " "))


def gives_orders(col: Column) -> Column:
    return flag(col, "inyeccion")


def check(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim, veredicto. claims: claim, texto, id, campo, pasaje (one row per citation; id null for none);
    evidence: id, campos (map of texts). A claim stands if one of its citations does and its figures are supported."""
    e = evidence.select(F.col("id").alias("_id"), "campos")
    c = claims.join(e, F.col("id") == F.col("_id"), "left")
    field = F.try_element_at("campos", F.col("campo"))
    fault = (
        F.when(F.col("id").isNull(), "sin cita")
        .when(F.col("_id").isNull(), "registro desconocido")
        .when(field.isNull(), "campo ausente")
        .when(gives_orders(field), "fuente con órdenes")
        .when(~F.contains(normalised(field), normalised(F.col("pasaje"))), "pasaje ausente")
    )
    rank = F.coalesce(*[F.when(fault == x, i) for i, x in enumerate(("sin cita", "registro desconocido", "campo ausente", "fuente con órdenes", "pasaje ausente"))], F.lit(9))
    best = c.select("claim", "texto", fault.alias("f"), rank.alias("r"), F.when(rank == 9, field).alias("fuente"))
    one = best.groupBy("claim").agg(F.max("r").alias("r"), F.max_by("f", "r").alias("f"), F.first("texto").alias("texto"), F.concat_ws(" ", F.collect_list("fuente")).alias("fuente"))
    bad = figures.unsupported(one.filter("r = 9"), "claim", "texto", "fuente").groupBy("claim").agg(F.array_join(F.sort_array(F.collect_set("cifra")), ", ").alias("cifras"))
    return one.join(bad, "claim", "left").select("claim", F.coalesce("f", F.when(F.col("cifras").isNotNull(), F.concat(F.lit("cifra sin apoyo: "), "cifras")), F.lit("vale")).alias("veredicto"))
