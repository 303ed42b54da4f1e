"""Queries on texts: normal forms, stems, topics, provenance, similarity, search, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brujula.functions import normal
from brujula.functions.text import folded
from brujula.operators import figures, lexical, validation
from brujula.operators.components import components
from brujula.plans import reports, tables
from brujula.session import cut, spread, table

#: Keywords of the topics, folded; those of four letters or fewer are whole words (fixed values).
TOPIC_WORDS = {
    "economía": ("economi", "inflacion", "precio", "empleo", "desempleo", "salario", "pib", "credito", "banco", "bancari", "inversion", "impuesto", "deuda", "presupuesto", "export", "import", "comercio", "canasta", "costo de vida", "mercado", "fiscal", "dgi", "mef", "economy", "inflation", "prices"),
    "logística/Canal": ("canal", "esclusa", "transito", "buque", "naviera", "puerto", "portuari", "contenedor", "carga", "logistic", "calado", "gatun", "acp", "maritim", "shipping", "vessel", "port"),
    "turismo": ("turis", "turista", "hotel", "hoteler", "crucero", "visitante", "aerolinea", "vuelo", "tocumen", "atp", "playa", "tourism", "tourist"),
    "servicios públicos": ("idaan", "agua potable", "electricidad", "luz", "apagon", "basura", "recoleccion", "metro", "mibus", "transporte publico", "hospital", "css", "seguro social", "escuela", "meduca", "minsa", "carretera", "acueducto", "potabilizadora"),
    "eventos naturales": ("sismo", "terremoto", "temblor", "lluvia", "inundacion", "deslizamiento", "sequia", "el nino", "la nina", "tormenta", "huracan", "sinaproc", "vaguada", "earthquake", "flood", "drought", "storm"),
    "regulación": ("ley", "decreto", "asamblea", "reforma", "resolucion", "norma", "reglament", "superintendencia", "regulador", "asep", "corte suprema", "fallo", "gaceta oficial", "proyecto de ley", "regulation", "law"),
}
#: News agencies and how texts name them; the first that matches counts (fixed values).
AGENCIES = {
    "EFE": r"\bEFE\b",
    "AFP": r"\bAFP\b",
    "AP": r"\(AP\)|\bAP:|\bla AP\b|\bAssociated Press\b",
    "Reuters": r"\bReuters\b",
    "Europa Press": r"\bEuropa Press\b",
    "Xinhua": r"\bXinhua\b",
    "Prensa Latina": r"\bPrensa Latina\b",
    "ANSA": r"\bANSA\b",
    "DPA": r"\bDPA\b|\bdpa\b",
    "Bloomberg": r"\bBloomberg\b",
}


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "noticias")


def url_normal(spark, d):
    n = _news(spark, d).filter("url IS NOT NULL").select("fila", normal.normal_url(F.col("url")).alias("url"))
    return n.select("fila", "url", normal.news_id(F.col("url")).alias("id"), normal.provisional_cluster(normal.news_id(F.col("url"))).alias("cluster"))


def plain_text(spark, d):
    return _news(spark, d).select("fila", normal.plain_text(F.col("descripcion")).alias("texto"))


def headline(spark, d):
    return _news(spark, d).select("fila", normal.clean_headline(F.col("titulo")).alias("titulo"), normal.slug(F.col("medio")).alias("medio"), F.coalesce(normal.word_count(F.col("titulo")), F.lit(0)).alias("palabras"))


def stems(spark, d):
    return _news(spark, d).filter("titulo IS NOT NULL").select("fila", F.array_join(lexical.stems(F.col("titulo")), " ").alias("raices"))


def content_words(spark, d):
    return _news(spark, d).filter("titulo IS NOT NULL").select("fila", F.array_join(F.sort_array(F.array_distinct(lexical.content_stems(F.col("titulo")))), " ").alias("raices"))


def _pattern(words) -> str:
    """Keywords at a word's start in a text whose words are apart by two spaces; short ones are whole words."""
    return " (?:" + "|".join(w.replace(" ", "  ") + (" " if len(w) <= 4 else "") for w in words) + ")"


def topic_keywords(spark, d):
    """Topic with the most keyword hits in title and description, and its share of all hits."""
    text = F.concat(F.lit("  "), F.regexp_replace(folded(F.concat_ws(". ", "titulo", "descripcion")), r"\W+", "  "), F.lit("  "))
    # inside the lambda the text is evaluated once, not once per topic
    hits = F.transform(F.array(text), lambda x: F.struct(*[F.regexp_count(x, F.lit(_pattern(ws))).alias(t) for t, ws in TOPIC_WORDS.items()]))
    n = spread(_news(spark, d).select("fila", "titulo", "descripcion"), "fila").select("fila", F.explode(hits).alias("h")).select("fila", "h.*")
    names = list(TOPIC_WORDS)
    most, total = F.greatest(*[F.col(f"`{t}`") for t in names]), sum((F.col(f"`{t}`") for t in names), F.lit(0))
    best = F.coalesce(*[F.when(F.col(f"`{t}`") == most, t) for t in names])
    return n.select("fila", F.when(total == 0, "otro").otherwise(best).alias("tema"), F.when(total == 0, 0.0).otherwise(F.round(most / total, 4)).alias("parte"))


def _agency():
    text = F.concat_ws(" \n ", F.coalesce("titulo", F.lit("")), F.coalesce("descripcion", F.lit("")), F.coalesce("medio", F.lit("")))
    return F.coalesce(*[F.when(text.rlike(p), a) for a, p in AGENCIES.items()])


def agency(spark, d):
    return _news(spark, d).select("fila", _agency().alias("agencia"))


def _title_vectors(spark, d):
    rows = _news(spark, d).filter("titulo IS NOT NULL").select("fila", "titulo")
    counts = lexical.term_counts(rows, "fila", lexical.plain_terms(F.col("titulo")))
    return lexical.unit_vectors(counts, "fila", lexical.idf(counts, "fila"))


def tfidf(spark, d):
    return _title_vectors(spark, d).select("fila", "w", F.round("x", 6).alias("x"))


def _instant():
    return F.coalesce(validation.iso_timestamp(F.col("fecha_publicacion")), validation.iso_timestamp(F.col("fecha_deteccion")))


def near_copies(spark, d):
    """Titles with a TF-IDF cosine of 0.9 or more, in other outlets, published or detected at most 48 hours apart (ISO dates)."""
    rows = _news(spark, d).filter("titulo IS NOT NULL").select("fila", "titulo", "dominio", _instant().alias("t"))
    return lexical.near_copies(rows, "fila", "titulo", "t", 0.9, 48, "dominio").select("a", "b", F.round("sim", 6).alias("sim"))


def title_groups(spark, d):
    """Groups of titles with a TF-IDF cosine of 0.9 or more within 72 hours, whatever the outlet: fila, grupo (its first row)."""
    rows = _news(spark, d).filter("titulo IS NOT NULL").select("fila", "titulo", _instant().alias("t"))
    comp = components(cut(lexical.near_copies(rows, "fila", "titulo", "t", 0.9, 72), "copies"), "a", "b")
    return rows.join(comp, F.col("fila") == F.col("nodo"), "left").select("fila", F.coalesce("componente", "fila").alias("grupo"))


def _provenance(spark, d):
    """fila, procedencia; the outlet of a group is that of its earliest row, rows without a date coming last."""
    comp = components(cut(near_copies(spark, d), "copies"), "a", "b")
    rows = _news(spark, d).select("fila", _agency().alias("ag"), F.coalesce("dominio", "medio", F.lit("desconocido")).alias("dom"), _instant().alias("t")).join(comp, F.col("fila") == F.col("nodo"), "left")
    rows = rows.withColumn("g", F.coalesce("componente", "fila"))
    group = rows.groupBy("g").agg(F.min("ag").alias("agencia"), F.min_by("dom", F.struct(F.col("t").isNull(), "t", "fila")).alias("primero"))
    named = F.when(F.col("agencia").isNotNull(), F.concat(F.lit("P-AG-"), normal.slug(F.col("agencia")))).otherwise(F.concat(F.lit("P-"), normal.slug(F.col("primero"))))
    return rows.join(group, "g").select("fila", named.alias("procedencia"))


def provenance(spark, d):
    """Independent origin of each row: of a group of near copies its agency (alphabetically first), else the domain of
    its earliest row; of a single row its agency, else its domain or outlet."""
    return _provenance(spark, d)


def baseline(spark, d):
    """Per row: topic by keywords, its share, provenance, and the stable id of its group of near titles."""
    groups = cut(title_groups(spark, d), "groups")
    ids = _news(spark, d).filter("id_noticia IS NOT NULL").select("fila", "id_noticia")
    keys = lexical.group_keys(groups.join(ids, "fila"), "grupo", "id_noticia")
    base = topic_keywords(spark, d).join(_provenance(spark, d), "fila")
    return base.join(groups, "fila", "left").join(keys, "grupo", "left").select("fila", "tema", "parte", "procedencia", "clave")


def novelty(spark, d):
    """Novelty of each provisional cluster against those first published in the seven days before."""
    t = F.unix_seconds(F.min(validation.iso_timestamp(F.col("fecha_publicacion"))))
    items = _news(spark, d).groupBy(F.col("cluster_id").alias("id")).agg(t.alias("t"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fila", "titulo"))), lambda x: F.coalesce(x.titulo, F.lit(""))), " ").alias("texto"))
    return lexical.novelty(items).withColumnRenamed("id", "cluster_id")


def _passages(spark, d):
    """Titles, descriptions and official records as passages: pasaje, evidencia, texto, reciente (seconds, or a year)."""
    when = F.coalesce(F.unix_seconds(_instant()), F.lit(0))
    news = _news(spark, d)
    field = lambda c: news.filter(F.col(c).isNotNull()).select(F.concat_ws("/", "fila", F.lit(c)).alias("pasaje"), F.col("fila").cast("string").alias("evidencia"), F.col(c).alias("texto"), when.alias("reciente"))
    official = reports.official_passages(spark, d).select("pasaje", F.col("pasaje").alias("evidencia"), "texto", "reciente")
    return field("titulo").unionByName(field("descripcion")).unionByName(official)


def _asked(spark, d):
    labels = table(spark, d, "etiquetas").groupBy("id_noticia").agg(F.min("titulo").alias("texto"))
    return labels.filter("id_noticia IS NOT NULL AND texto IS NOT NULL").withColumnRenamed("id_noticia", "consulta")


def search(spark, d):
    """Ten best passages of news and official records for each labelled headline."""
    return lexical.ranked_search(_asked(spark, d), _passages(spark, d))


def search_evidence(spark, d):
    """The distinct evidence of each search in the order of its hits."""
    hits = search(spark, d).withColumn("evidencia", F.regexp_replace("pasaje", "/.*$", ""))
    return lexical.evidence_in_order(hits, "evidencia")


def figures_found(spark, d):
    return figures.extract(_news(spark, d).filter("descripcion IS NOT NULL"), "fila", "descripcion")


def figures_unsupported(spark, d):
    """Figures of descriptions that their own titles don't support."""
    return figures.unsupported(_news(spark, d).filter("descripcion IS NOT NULL AND titulo IS NOT NULL"), "fila", "descripcion", "titulo")


def figure_conflicts(spark, d):
    """Rows on one topic from one outlet whose figures of one unit differ (provisional clusters of these tables hold one row each)."""
    when = F.coalesce(validation.iso_timestamp(F.col("fecha_publicacion")), validation.iso_timestamp(F.col("fecha_deteccion")))
    news = _news(spark, d).filter("tema IS NOT NULL AND dominio IS NOT NULL").select("fila", F.concat_ws("|", "tema", "dominio").alias("grupo"), F.concat_ws(" ", "titulo", "descripcion").alias("texto"), when.alias("t"))
    return figures.conflicts(news, "grupo", "fila", "texto", "t")


def citations(spark, d):
    """Whether the text of each label is found in the row that it names (folded, spaces drawn together)."""
    norm = lambda c: F.regexp_replace(folded(c), r"[\s ]+", " ")
    cites = table(spark, d, "etiquetas").filter("id_noticia IS NOT NULL").select("id_noticia", F.col("titulo").alias("pasaje"))
    rows = _news(spark, d).filter("id_noticia IS NOT NULL AND titulo IS NOT NULL").select("id_noticia", "titulo")
    return cites.join(rows, "id_noticia").groupBy("id_noticia", "pasaje").agg(F.bool_or(F.contains(norm(F.col("titulo")), norm(F.col("pasaje")))).alias("valida"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        url_normal, plain_text, headline, stems, content_words, topic_keywords, agency, tfidf, near_copies, provenance, title_groups, baseline, novelty, search, search_evidence,
        figures_found, figures_unsupported, figure_conflicts, citations,
    )
}

#: Character entities that occur in these tables and what they stand for (fixed values).
ENTITIES = (("&nbsp;", " "), ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&ntilde;", "ñ"), ("&hellip;", "…"), ("&#8230;", "…"), ("&#233;", "é"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_STOP = ", ".join(f"'{w}'" for w in lexical.STOP)
_F = "strip_accents(lower({c}))"


def stems_sql(c: str) -> str:
    joined = rf"regexp_replace(strip_accents(lower({c})), '(^|[^\p{{L}}\p{{N}}_])([\p{{L}}\p{{N}}_])\s*&\s*([\p{{L}}\p{{N}}_])($|[^\p{{L}}\p{{N}}_])', '\1\2\3\4', 'g')"
    return rf"list_transform(list_filter(regexp_extract_all({joined}, '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN w ELSE left(w, 5) END)"


_STEMS = stems_sql("titulo")
_PLAIN = "regexp_replace(descripcion, '<[^>]+>', ' ', 'g')"
for _e, _s in ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_s.replace(chr(39), chr(39) * 2)}')"
_HITS = ", ".join("len(regexp_extract_all(x, '" + _pattern(ws) + f"')) AS h{i}" for i, ws in enumerate(TOPIC_WORDS.values()))
_TEXT = r"'  ' || regexp_replace(strip_accents(lower(concat_ws('. ', titulo, descripcion))), '[^a-z0-9_]+', '  ', 'g') || '  '"
_AG = "coalesce(titulo, '') || ' ' || chr(10) || ' ' || coalesce(descripcion, '') || ' ' || chr(10) || ' ' || coalesce(medio, '')"
_TFIDF = r"""
    t AS (SELECT {key} AS k, unnest(regexp_extract_all(strip_accents(lower({text})), '{tok}')) AS w FROM {src}),
    c AS (SELECT k, w, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT k) AS n FROM c),
    i AS (SELECT w, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1),
    v AS (SELECT k, w, tf * idf AS v FROM c JOIN i USING (w)),
    x AS (SELECT k, w, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS x FROM v)"""
_ISO = tables._iso
_TOK2 = r"[\p{L}\p{N}_]{2,}"
_QUERY = "regexp_replace(lower(trim(regexp_replace(url, '#.*$', ''))), '^[^?]*', '')"

_WHEN = f"coalesce({_ISO('fecha_publicacion')}, {_ISO('fecha_deteccion')})"


def _copies(name: str, hours: int, apart: str) -> str:
    return f"""
    w{name} AS MATERIALIZED (SELECT fila, dominio, {_WHEN} AS t, CAST(floor(epoch({_WHEN}) / 3600 / {hours}) AS BIGINT) AS g FROM noticias WHERE titulo IS NOT NULL AND {_WHEN} IS NOT NULL),
    c{name} AS (SELECT a.fila AS a, b.fila AS b FROM (SELECT *, unnest([g - 1, g, g + 1]) AS h FROM w{name}) a JOIN w{name} b ON b.g = a.h AND a.fila < b.fila AND abs(epoch_us(a.t) - epoch_us(b.t)) <= {hours} * 3600000000 {apart}),
    {name} AS (SELECT c.a, c.b, sum(x.x * y.x) AS sim FROM c{name} c JOIN x ON x.k = c.a JOIN x y ON y.k = c.b AND y.w = x.w GROUP BY 1, 2 HAVING sum(x.x * y.x) >= 0.9 - 1e-9)"""


_REACH = """
    e{name} AS (SELECT a, b FROM {name} UNION SELECT b, a FROM {name}),
    r{name}(n, m) AS (SELECT a, a FROM e{name} UNION SELECT r.n, e.b FROM r{name} r JOIN e{name} e ON e.a = r.m),
    k{name} AS (SELECT n, min(m) AS grupo FROM r{name} GROUP BY 1)"""
_TITLES = _TFIDF.format(key="fila", text="titulo", src="(SELECT fila, titulo FROM noticias WHERE titulo IS NOT NULL)", tok=_TOK2)
_GROUPS = _TITLES + "," + _copies("near", 72, "") + "," + _REACH.format(name="near") + ", titled AS (SELECT n.fila, coalesce(k.grupo, n.fila) AS grupo FROM noticias n LEFT JOIN knear k ON k.n = n.fila WHERE n.titulo IS NOT NULL)"
_SLUG = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_AGENCY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{a}'" for a, p in AGENCIES.items()) + " END"
_PROVENANCE = (
    _TITLES + "," + _copies("pairs", 48, "AND a.dominio <> b.dominio") + "," + _REACH.format(name="pairs")
    + f", base AS (SELECT fila, {_AGENCY_SQL} AS ag, dom, t, coalesce(k.grupo, fila) AS g FROM (SELECT fila, {_AG} AS x, coalesce(dominio, medio, 'desconocido') AS dom, {_WHEN} AS t FROM noticias) n LEFT JOIN kpairs k ON k.n = n.fila)"
    + f", named AS (SELECT g, CASE WHEN min(ag) IS NOT NULL THEN 'P-AG-' || {_SLUG.format(c='min(ag)')} ELSE 'P-' || {_SLUG.format(c='first(dom ORDER BY t ASC NULLS LAST, fila)')} END AS procedencia FROM base GROUP BY 1), prov AS (SELECT fila, procedencia FROM base JOIN named USING (g))"
)
_SEARCH = f"""
    ps AS MATERIALIZED (
      SELECT fila || '/titulo' AS pasaje, titulo AS texto, coalesce(CAST(floor(epoch({_WHEN})) AS BIGINT), 0) AS reciente FROM noticias WHERE titulo IS NOT NULL
      UNION ALL SELECT fila || '/descripcion', descripcion, coalesce(CAST(floor(epoch({_WHEN})) AS BIGINT), 0) FROM noticias WHERE descripcion IS NOT NULL
      UNION ALL SELECT pasaje, texto, reciente FROM ({reports.SQL["official_passages"]})),
    qs AS (SELECT id_noticia AS consulta, min(titulo) AS texto FROM etiquetas WHERE id_noticia IS NOT NULL AND titulo IS NOT NULL GROUP BY 1),
    p AS MATERIALIZED (SELECT pasaje, reciente, {stems_sql("texto")} AS s FROM ps),
    q AS MATERIALIZED (SELECT consulta, list_distinct({stems_sql("texto")}) AS s, {stems_sql("texto")} AS a FROM qs),
    c AS (SELECT pasaje, w, count(*) AS tf FROM (SELECT pasaje, unnest(s) AS w FROM p) WHERE NOT regexp_matches(w, '^[0-9]') GROUP BY 1, 2),
    i AS (SELECT w, ln((1 + (SELECT count(*) FROM p)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1),
    pv AS (SELECT pasaje, w, v / sqrt(sum(v * v) OVER (PARTITION BY pasaje)) AS y FROM (SELECT pasaje, w, (1 + ln(tf)) * idf AS v FROM c JOIN i USING (w))),
    qc AS (SELECT consulta, w, count(*) AS tf FROM (SELECT consulta, unnest(a) AS w FROM q) WHERE NOT regexp_matches(w, '^[0-9]') GROUP BY 1, 2),
    qv AS (SELECT consulta, w, v / sqrt(sum(v * v) OVER (PARTITION BY consulta)) AS x FROM (SELECT consulta, w, (1 + ln(tf)) * idf AS v FROM qc JOIN i USING (w))),
    sc AS (SELECT consulta, pasaje, sum(x * y) AS s FROM qv JOIN pv USING (w) GROUP BY 1, 2),
    good AS (SELECT sc.consulta, sc.pasaje, p.reciente, sc.s + CASE WHEN len(list_filter(list_intersect(q.s, p.s), lambda w: regexp_matches(w, '^(19|20)[0-9]{{2}}$'))) > 0 THEN 0.15 ELSE 0 END AS s
             FROM sc JOIN p USING (pasaje) JOIN q USING (consulta) WHERE len(list_intersect(q.s, p.s)) >= 0.5 * len(q.s)),
    best AS (SELECT consulta, pasaje, round(s, 4) AS puntaje, row_number() OVER (PARTITION BY consulta ORDER BY round(s, 6) DESC, reciente DESC NULLS LAST, pasaje) AS puesto FROM good WHERE s >= 0.1 QUALIFY puesto <= 10)"""

SQL = {
    "url_normal": r"""
        WITH b AS (SELECT fila, regexp_replace(trim(url), '#.*$', '') AS u FROM noticias WHERE url IS NOT NULL),
        p AS (SELECT fila, split_part(u, '?', 1) AS path, list_filter(string_split(CASE WHEN contains(u, '?') THEN regexp_extract(u, '\?(.*)$', 1) ELSE '' END, '&'), lambda q: q <> '' AND NOT regexp_full_match(q, '(?i)(utm_\w+|fbclid|gclid|ocid|cmpid)(=.*)?')) AS q FROM b),
        e AS (SELECT fila, path, list_transform(list_transform(q, lambda a: CASE WHEN contains(a, '=') THEN a ELSE a || '=' END), lambda a: [url_decode(replace(regexp_extract(a, '^([^=]*)=', 1), '+', ' ')), url_decode(replace(regexp_extract(a, '^[^=]*=(.*)$', 1), '+', ' '))]) AS q FROM p),
        j AS (SELECT fila, regexp_replace(path, '^(?i)(https?):(/[^/])', '\1://\2') AS path, array_to_string(list_transform(q, lambda a: replace(url_encode(a[1]) || '=' || url_encode(a[2]), '%20', '+')), '&') AS q FROM e),
        r AS (SELECT fila, regexp_replace(lower(CASE WHEN q = '' THEN path ELSE path || '?' || q END), '/+$', '') AS url FROM j)
        SELECT fila, url, 'N-' || left(sha1(url), 10) AS id, 'K-' || left(sha1(url), 10) AS cluster FROM r""",
    "plain_text": rf"SELECT fila, nullif(trim(regexp_replace({_PLAIN}, '[\s\x{{00A0}}]+', ' ', 'g')), '') AS texto FROM noticias",
    "headline": r"SELECT fila, trim(regexp_replace(regexp_replace(titulo, '[\s\x{00A0}]+', ' ', 'g'), ' +([,.;:!?])', '\1', 'g')) AS titulo, regexp_replace(regexp_replace(lower(medio), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS medio, CAST(coalesce(len(regexp_extract_all(titulo, '[\p{L}\p{N}_]+(?:[-''’][\p{L}\p{N}_]+)*')), 0) AS INTEGER) AS palabras FROM noticias",
    "stems": f"SELECT fila, array_to_string({_STEMS}, ' ') AS raices FROM noticias WHERE titulo IS NOT NULL",
    "content_words": f"SELECT fila, array_to_string(list_sort(list_distinct(list_filter({_STEMS}, lambda w: NOT regexp_matches(w, '^[0-9]')))), ' ') AS raices FROM noticias WHERE titulo IS NOT NULL",
    "topic_keywords": f"WITH h AS (SELECT fila, {_HITS} FROM (SELECT fila, {_TEXT} AS x FROM noticias)), g AS (SELECT *, greatest(h0, h1, h2, h3, h4, h5) AS m, h0 + h1 + h2 + h3 + h4 + h5 AS s FROM h) SELECT fila, CASE WHEN s = 0 THEN 'otro' " + " ".join(f"WHEN h{i} = m THEN '{t}'" for i, t in enumerate(TOPIC_WORDS)) + " END AS tema, CASE WHEN s = 0 THEN 0.0 ELSE round(m / s, 4) END AS parte FROM g",
    "agency": "SELECT fila, CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{a}'" for a, p in AGENCIES.items()) + f" END AS agencia FROM (SELECT fila, {_AG} AS x FROM noticias)",
    "tfidf": "WITH " + _TFIDF.format(key="fila", text="titulo", src="noticias", tok=_TOK2) + " SELECT k AS fila, w, round(x, 6) AS x FROM x",
    "novelty": "WITH s AS (SELECT cluster_id, CAST(epoch(min(" + _ISO("fecha_publicacion") + ")) AS BIGINT) AS s, string_agg(coalesce(titulo, ''), ' ' ORDER BY fila) AS texto FROM noticias GROUP BY 1)," + _TFIDF.format(key="cluster_id", text="texto", src="s", tok=_TOK2) + ", p AS (SELECT a.k, b.k AS k2, sum(a.x * b.x) AS sim FROM x a JOIN s sa ON sa.cluster_id = a.k JOIN x b ON b.w = a.w JOIN s sb ON sb.cluster_id = b.k WHERE sa.s - sb.s > 0 AND sa.s - sb.s <= 604800 GROUP BY 1, 2) SELECT s.cluster_id, round(greatest(0.0, least(1.0, 1 - coalesce(max(p.sim), 0))), 4) AS novedad FROM s LEFT JOIN p ON p.k = s.cluster_id GROUP BY 1",
    "citations": r"SELECT e.id_noticia, e.titulo AS pasaje, bool_or(contains(regexp_replace(strip_accents(lower(n.titulo)), '[\s\x{00A0}]+', ' ', 'g'), regexp_replace(strip_accents(lower(e.titulo)), '[\s\x{00A0}]+', ' ', 'g'))) AS valida, count(*) AS n FROM etiquetas e JOIN noticias n ON n.id_noticia = e.id_noticia AND n.titulo IS NOT NULL GROUP BY 1, 2",
    "near_copies": "WITH " + _TFIDF.format(key="fila", text="titulo", src="(SELECT fila, titulo FROM noticias WHERE titulo IS NOT NULL)", tok=_TOK2) + "," + _copies("pairs", 48, "AND a.dominio <> b.dominio") + " SELECT a, b, round(sim, 6) AS sim FROM pairs",
    "title_groups": "WITH RECURSIVE " + _GROUPS + " SELECT fila, grupo FROM titled",
    "provenance": "WITH RECURSIVE " + _PROVENANCE + " SELECT fila, procedencia FROM prov",
    "baseline": "WITH RECURSIVE " + _GROUPS + ", prov0 AS (" + "WITH RECURSIVE " + _PROVENANCE + " SELECT fila, procedencia FROM prov), topics AS (" + "{topics}" + "), ids AS (SELECT grupo, CASE WHEN count(*) = 1 THEN 'K-' || substring(min(id_noticia), 3) ELSE 'K-' || left(sha1(string_agg(id_noticia, '|' ORDER BY id_noticia)), 10) END AS clave FROM (SELECT DISTINCT t.grupo, n.id_noticia FROM titled t JOIN noticias n USING (fila) WHERE n.id_noticia IS NOT NULL) GROUP BY 1) SELECT t.fila, t.tema, t.parte, p.procedencia, i.clave FROM topics t JOIN prov0 p USING (fila) LEFT JOIN titled g USING (fila) LEFT JOIN ids i USING (grupo)",
    "search": "WITH " + _SEARCH + " SELECT consulta, pasaje, puntaje, puesto FROM best",
    "search_evidence": "WITH " + _SEARCH + " SELECT consulta, evidencia, row_number() OVER (PARTITION BY consulta ORDER BY p) AS orden FROM (SELECT consulta, split_part(pasaje, '/', 1) AS evidencia, min(puesto) AS p FROM best GROUP BY 1, 2)",
}
SQL["baseline"] = SQL["baseline"].replace("{topics}", SQL["topic_keywords"])
