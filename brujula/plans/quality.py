"""Queries p2 and p3: data quality of the news table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brujula.operators import profile, timestamps
from brujula.session import cut, table

COLUMNS = ["descripcion", "url", "id_noticia"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "noticias")
    cells = profile.violations(news, profile.NEWS_SPECS, "fila").select("columna", F.lit("patron").alias("problema"), F.col("fila").cast("bigint").alias("clave"))
    loads = profile.load_shifts(cut(profile.load_figures(news, COLUMNS, "carga"), "figures")).select("columna", "problema", F.col("carga").cast("bigint").alias("clave"))
    return cells.unionByName(loads)


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(table(spark, d, "noticias"), profile.NEWS_SPECS)


def p2_loads(spark: SparkSession, d: str) -> DataFrame:
    f = profile.load_figures(table(spark, d, "noticias"), COLUMNS, "carga")
    return f.select("carga", "columna", "filas", "no_nulos", "distintos", F.round("nulos", 6).alias("nulos"), F.round("longitud", 6).alias("longitud"))


def p2_divergence(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_divergence(table(spark, d, "noticias"), {c: profile.NEWS_SPECS[c] for c in COLUMNS}, "carga")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.irregular_dates(table(spark, d, "noticias"), table(spark, d, "medios"))


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(table(spark, d, "noticias"), table(spark, d, "medios"))


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_loads, p2_divergence, p3_found, p3_normalised)}

_TRIMMED = r"regexp_replace(@, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')"
_PLAIN = r"trim(regexp_replace(strip_accents(lower(descripcion)), '[^\p{L}\p{N}]+', ' ', 'g'))"
_STAND = ", ".join(f"'{x}'" for x in profile.STAND_INS)

_BLANK = r"[\s\x{00A0}\x{2007}\x{202F}\x{3000}\x{FEFF}]"


def _mask_sql(value: str, form: profile.Form) -> str:
    out = f"regexp_replace({value}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    if form.keep:
        out = f"translate({out}, '{form.keep}', '{profile.PRIVATE}')"
    for pattern, sign in form.steps:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), sign)
    return f"translate({out}, '{profile.PRIVATE}', '{form.keep}')" if form.keep else out


_NEWS = "fila id_noticia titulo descripcion url medio dominio idioma fecha_publicacion fecha_deteccion fecha_extraccion origen alcance_texto procedencia_id tema tema_confianza cluster_id sintetico recirculada carga".split()
_FIGURES = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) AS filas, count(*) - count({c}) AS nulos, CAST(min({c}) AS VARCHAR) AS minimo, CAST(max({c}) AS VARCHAR) AS maximo, min(length(CAST({c} AS VARCHAR))) AS largo_minimo, max(length(CAST({c} AS VARCHAR))) AS largo_maximo, round(avg(length(CAST({c} AS VARCHAR))), 4) AS largo_medio, count(DISTINCT {c}) AS distintos FROM noticias"
    for c in _NEWS
)
_MASKS = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, {_mask_sql(f'CAST({c} AS VARCHAR)', profile.NEWS_SPECS.get(c, profile.GENERIC))} AS mascara, count(*) AS n FROM noticias WHERE {c} IS NOT NULL GROUP BY 2" for c in _NEWS
)
_BY_LOAD = " UNION ALL ".join(f"SELECT carga, '{c}' AS columna, {_mask_sql(c, profile.NEWS_SPECS[c])} AS mascara, count(*) AS n FROM noticias WHERE {c} IS NOT NULL AND carga IS NOT NULL GROUP BY 1, 3" for c in COLUMNS)

SQL = {
    "p2_loads": """
        SELECT carga, columna, count(*) AS filas, count(valor) AS no_nulos, count(DISTINCT valor) AS distintos,
               round(1 - count(valor) / count(*), 6) AS nulos, round(avg(length(valor)), 6) AS longitud
        FROM (SELECT carga, 'descripcion' AS columna, descripcion AS valor FROM noticias
              UNION ALL SELECT carga, 'url', url FROM noticias
              UNION ALL SELECT carga, 'id_noticia', id_noticia FROM noticias) GROUP BY 1, 2""",
    "p2_found": rf"""
        WITH l AS (
          SELECT carga, columna, count(valor) / count(*) AS llenos, count(DISTINCT valor) / nullif(count(valor), 0) AS d, avg(length(valor)) AS m
          FROM (SELECT carga, 'descripcion' AS columna, descripcion AS valor FROM noticias
                UNION ALL SELECT carga, 'url', url FROM noticias
                UNION ALL SELECT carga, 'id_noticia', id_noticia FROM noticias) GROUP BY 1, 2),
        s AS (SELECT a.*, b.llenos AS llenos0, b.d AS d0, b.m AS m0 FROM l a JOIN l b ON b.carga = a.carga - 1 AND b.columna = a.columna)
        SELECT 'id_noticia' AS columna, 'patron' AS problema, fila AS clave FROM noticias
        WHERE NOT regexp_full_match({_TRIMMED.replace("@", "id_noticia")}, 'N-[0-9a-f]{{10}}')
        UNION ALL SELECT 'url', 'patron', fila FROM noticias
        WHERE NOT regexp_full_match({_TRIMMED.replace("@", "url")}, '(?i)https?://[^/?#\s]*\.[^/?#\s]*([/?#][^\s\x{{00A0}}]*)?')
        UNION ALL SELECT 'descripcion', 'patron', fila FROM noticias
        WHERE {_PLAIN} = '' OR {_PLAIN} IN ({_STAND}) OR regexp_matches(descripcion, '</?[A-Za-z][^<>]*>|<!--|&(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z]{{2,10}}[0-9]{{0,2}});')
           OR regexp_matches(descripcion, '[\x{{00C2}}\x{{00C3}}][\x{{0080}}-\x{{00BF}}\x{{0152}}-\x{{0178}}\x{{2013}}-\x{{203A}}\x{{20AC}}]|\x{{FFFD}}')
        UNION ALL SELECT columna, 'nulos', carga FROM s WHERE abs(llenos - llenos0) > 0.1
        UNION ALL SELECT columna, 'distintos', carga FROM s WHERE abs(d - d0) > 0.1
        UNION ALL SELECT columna, 'longitud', carga FROM s WHERE abs(m - m0) > 0.2 * m0""",
    "p2_profile": f"""
        WITH f AS ({_FIGURES}), m AS ({_MASKS}),
        t AS (SELECT columna, count(*) AS mascaras, max({{'n': n, 'm': mascara}}) AS top, sum(n) AS total FROM m GROUP BY 1)
        SELECT f.*, t.mascaras, t.top.m AS mascara_dominante, round(t.top.n / t.total, 6) AS parte_dominante FROM f LEFT JOIN t USING (columna)""",
    "p2_divergence": f"""
        WITH m AS ({_BY_LOAD}), t AS (SELECT carga, columna, sum(n) AS total, count(*) AS mascaras FROM m GROUP BY 1, 2),
        p AS (SELECT carga, columna, mascara, n / total AS p FROM m JOIN t USING (carga, columna)),
        k AS (SELECT a.carga, a.columna, a.mascaras FROM t a JOIN t b ON b.carga = a.carga - 1 AND b.columna = a.columna),
        b AS (SELECT coalesce(x.carga, y.carga + 1) AS carga, coalesce(x.columna, y.columna) AS columna, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q
              FROM p x FULL JOIN p y ON y.carga = x.carga - 1 AND y.columna = x.columna AND y.mascara = x.mascara),
        h AS (SELECT carga, columna, CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END AS j FROM b)
        SELECT k.carga, k.columna, k.mascaras, greatest(round(sum(j) / 2, 6), 0.0) AS divergencia FROM h JOIN k USING (carga, columna) GROUP BY 1, 2, 3""",
}
