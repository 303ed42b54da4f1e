"""URL normal form: one key for the spellings of one page."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa

#: Parameters that only track a visit (fixed values).
TRACKING = re.compile(r"(?:utm_\w+|fbclid|gclid|ocid|cmpid)\Z", re.IGNORECASE)
_PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\[\]?#%\\]+\Z")


def page_key(url: str | None) -> str | None:
    """Trimmed, without fragment and tracking parameters, other parameters re-encoded, all in
    lower case, without slashes at the end. None for None and for a url that can't be split."""
    if url is None:
        return None
    url = url.strip()
    if _PLAIN.match(url):  # nothing to take out or to encode anew
        return url.lower().rstrip("/")
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    query = parts.query
    if query:
        kept = [pair for pair in parse_qsl(query, keep_blank_values=True) if not TRACKING.match(pair[0])]
        query = urlencode(kept)
    return urlunsplit(parts._replace(query=query, fragment="")).lower().rstrip("/")


def page_keys(urls: pa.Array) -> pa.Array:
    """The normal form of each url, each distinct one worked out once."""
    distinct = urls.dictionary_encode()
    return pa.array([page_key(u) for u in distinct.dictionary.to_pylist()], type=pa.string()).take(distinct.indices)
