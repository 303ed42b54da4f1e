"""Normal forms as Spark columns: URLs, ids, plain text, headlines, slugs."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from brujula.functions.urls import page_keys


def normal_url(col: Column) -> Column:
    """The one normal form of a url (`brujula.functions.urls.page_key`)."""
    return F.arrow_udf(page_keys, "string")(col)


def news_id(url: Column) -> Column:
    return F.concat(F.lit("N-"), F.substring(F.sha1(url), 1, 10))


def provisional_cluster(ident: Column) -> Column:
    return F.concat(F.lit("K-"), F.substring(ident, 3, 1000))


def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([html.unescape(t) if t is not None and "&" in t else t for t in texts.to_pylist()], type=pa.string())


def plain_text(col: Column) -> Column:
    """Tags to spaces, character entities (named and numbered) to their signs, white space drawn together; empty becomes null."""
    out = F.arrow_udf(_unescaped, "string")(F.regexp_replace(col, r"<[^>]+>", " "))
    return F.nullif(F.trim(F.regexp_replace(out, r"[\s\u00a0]+", " ")), F.lit(""))


def slug(col: Column) -> Column:
    """Lower case, other signs than a-z and 0-9 to one dash (accents aren't folded)."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_headline(col: Column) -> Column:
    """Spaces before signs of punctuation taken out, white space drawn together."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"[\s ]+", " "), r" +([,.;:!?])", "$1"))


def word_count(col: Column) -> Column:
    """Words, counting those joined by dashes or apostrophes as one."""
    return F.size(F.regexp_extract_all(col, F.lit(r"([\p{L}\p{N}_]+(?:[-'’][\p{L}\p{N}_]+)*)"), 1))


def local_time(col: Column, zone: str) -> Column:
    """dd/MM/yyyy hh:mm a in a zone."""
    return F.date_format(F.from_utc_timestamp(col, zone), "dd/MM/yyyy hh:mm a")
