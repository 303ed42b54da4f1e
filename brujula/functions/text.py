"""Text helpers: word splitting in Python, and the same kinds of folding as Spark columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Runs of letters or digits of the folded text, in order."""
    return _RUN.findall(fold(text))


#: Accented letters of the corpus languages and their base letters (fixed values).
ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõøōŏőúùûüũūŭůűñńňçćčýÿžźżšśş"
BASE = "aaaaaaaaaeeeeeeeeeiiiiiiiiooooooooouuuuuuuuunnncccyyzzzsss"
#: Combining accents, which a decomposed letter carries behind it.
COMBINING = "".join(map(chr, range(0x300, 0x370)))


def folded(col: Column) -> Column:
    """Lower case without accents for Latin text, JVM-side."""
    return F.translate(F.lower(col), ACCENTED + COMBINING, BASE)


def trimmed(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, r"^[\s\u00a0\u2007\u202f\u3000\ufeff]+|[\s\u00a0\u2007\u202f\u3000\ufeff]+$", "")


def tokens(col: Column) -> Column:
    """Array of the runs of letters or digits of the folded text."""
    return F.regexp_extract_all(folded(col), F.lit(r"([\p{L}\p{N}]+)"), 1)
