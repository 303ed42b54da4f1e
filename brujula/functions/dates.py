"""Vectorised parsing of date texts in mixed formats (numpy and Arrow, no Spark).

Every text is generalised to a shape mask (digits to 9, runs of letters to a). Each
distinct mask is mapped to a parser once per batch; the parser then reads all texts of
that mask together with one RE2 pass and integer arithmetic. Local times are converted
through tables of zone transitions that are built once on the driver and carry the
version of the time zone database they come from.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SECOND = 1_000_000
INVALID = np.iinfo(np.int64).min
LARGEST = str(np.iinfo(np.int64).max)

#: Month names and their usual short forms, folded, in es, en, pt, fr, de and it.
MONTH_NAMES = {
    1: "enero january janeiro janvier januar gennaio ene jan janv gen",
    2: "febrero february fevereiro fevrier februar febbraio feb fev fevr febb",
    3: "marzo march marco mars marz mar mrz",
    4: "abril april avril aprile abr apr avr",
    5: "mayo may maio mai maggio mag",
    6: "junio june junho juin juni giugno jun giu",
    7: "julio july julho juillet juli luglio jul juil lug",
    8: "agosto august aout ago aug agos",
    9: "septiembre setiembre september setembro septembre settembre sep sept set",
    10: "octubre october outubro octobre oktober ottobre oct out okt ott",
    11: "noviembre november novembro novembre nov",
    12: "diciembre december dezembro decembre dezember dicembre dic dec dez",
}
MONTHS = {name: m for m, names in MONTH_NAMES.items() for name in names.split()}

#: Usual offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120,
    "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "est": -300,
    "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "ast": -240, "adt": -180, "cot": -300, "pet": -300, "brt": -180, "brst": -120, "art": -180,
    "clt": -240, "clst": -180, "hst": -600, "akst": -540, "akdt": -480,
}

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,12}))?)?(?:\s?(?P<p>[AaPp]\.?\s?[Mm]\.?))?"
_ZONE = r"(?:\s?(?P<z>\pL{1,5}|(?:(?:UTC|GMT|utc|gmt)\s?)?[+-]\d{2}:?\d{2}|[+-]\d{2})(?:\s\(\pL{1,5}\))?)?"
_REST = rf"(?:(?:,\s|\s|,|T|t|\sa las\s|\s-\s){_TIME}{_ZONE})?$"

#: Families of shapes: a pattern that the mask must match in full, the pattern that reads
#: the text, and the way its first two numbers are ordered.
FAMILIES = [
    ("ymd", r"9999(?P<s>[-/.])99?(?P=s)99?([a ].*)?", rf"^(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}}){_REST}"),
    ("compact", r"99999999a9{4,6}(\.9+)?( ?a|[+-]99:?99)?", rf"^(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt](?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:\.(?P<f>\d{{1,12}}))?{_ZONE}$"),
    ("slash", r"99?/99?/9999([ ,a].*)?", rf"^(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}}){_REST}"),
    ("dmy", r"99?(?P<s>[.-])99?(?P=s)9999([ ,a].*)?", rf"^(?P<d>\d{{1,2}})[.-](?P<m>\d{{1,2}})[.-](?P<y>\d{{4}}){_REST}"),
    ("named", r"(a\.?,? )?99?[ -](a )?a\.?[ -](a )?9999([ ,].*)?", rf"^(?:\pL+\.?,?\s)?(?P<d>\d{{1,2}})[ -](?:de )?(?P<n>\pL+)\.?[ -](?:de |del )?(?P<y>\d{{4}}){_REST}"),
    ("monthfirst", r"(a\.?,? )?a\.? 99?(a)?,? 9999([ ,].*)?", rf"^(?:\pL+\.?,\s)?(?P<n>\pL+)\.?\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y>\d{{4}}){_REST}"),
]
_FAMILIES = [(name, re.compile(mask), value) for name, mask, value in FAMILIES]

#: Cells of digits only: what each length means. Calendar digits or a count since 1970.
DIGITS = {8: "calendar", 12: "calendar", 14: "calendar", 9: SECOND, 10: SECOND, 11: SECOND, 13: 1000, 16: 1, 19: -1000}


def shape_masks(values: pa.Array) -> pa.Array:
    """Digits to 9 each, runs of letters to one a, every other sign as it is."""
    return pc.replace_substring_regex(pc.replace_substring_regex(values, r"[0-9]", "9"), r"\pL+", "a")


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> tuple[str, str | None]:
    """(family, pattern) of a mask; family 'none' if no date is written like that."""
    if re.fullmatch(r"9+", mask):
        return ("digits", None) if len(mask) in DIGITS else ("none", None)
    for name, pattern, value in _FAMILIES:
        if pattern.fullmatch(mask):
            return name, value
    return "none", None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of a civil date and whether that date exists."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok = (m >= 1) & (m <= 12) & (y >= 1)
    m = np.where(ok, m, 1)
    ok &= (d >= 1) & (d <= lengths[m] + ((m == 2) & leap))
    months = (y - 1970) * 12 + (m - 1)
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok


def _ints(column: pa.Array, missing: int = 0) -> np.ndarray:
    column = pc.replace_with_mask(column, pc.equal(pc.utf8_length(column), 0), pa.scalar(str(missing)))
    return pc.cast(pc.fill_null(column, str(missing)), pa.int64()).to_numpy(zero_copy_only=False)


def _lookup(column: pa.Array, of) -> np.ndarray:
    enc = column.dictionary_encode()
    table = np.array([of(x) for x in enc.dictionary.to_pylist()] or [0], dtype=np.int64)
    return table[enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)]


def _fold_month(name: str) -> int:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return MONTHS.get(plain, 0)


NO_ZONE, BAD_ZONE = 10**9, 10**9 + 1


def _offset_minutes(z: str) -> int:
    if not z:
        return NO_ZONE
    m = re.search(r"([+-])(\d{2}):?(\d{2})?$", z)
    if m:
        h, mi = int(m[2]), int(m[3] or 0)
        return BAD_ZONE if h > 18 or mi > 59 else (h * 60 + mi) * (1 if m[1] == "+" else -1)
    return ABBREVIATIONS.get(z.lower(), BAD_ZONE)


def zone_tables(zones: list[str], first: int = 1970, last: int = 2100) -> dict:
    """Transition tables {zone: (local switch times, offsets)} in microseconds, with the database's version.

    A local time before switch[i] has offsets[i]; the switch is placed so that a repeated
    hour is its first pass and a skipped hour keeps the offset before the change. An
    unknown zone gets no table (its local times are then unusable). Local times outside the
    years of the tables are looked up one by one.
    """
    from zoneinfo import ZoneInfo

    def offset(zone, seconds: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)).astimezone(zone).utcoffset().total_seconds())

    out = {}
    low, high = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first, last))
    for name in zones:
        try:
            zone = ZoneInfo(name)
        except Exception:  # noqa: BLE001 - any unreadable zone is an unknown zone
            continue
        switches, offsets = [], [offset(zone, low)]
        step = 7 * 86400
        for t in range(low, high, step):
            before, after = offsets[-1], offset(zone, t + step)
            if before != after:
                at = t + bisect_left(range(step), True, key=lambda s, t=t, before=before: offset(zone, t + s) != before)
                switches.append((at + max(before, after)) * SECOND)
                offsets.append(after)
        out[name] = (np.array(switches, dtype=np.int64), np.array(offsets, dtype=np.int64) * SECOND)
    return {"version": zone_version(), "zones": out, "span": ((low + 2 * 86400) * SECOND, (high - 2 * 86400) * SECOND)}


def zone_version() -> str:
    """Version of the time zone database in use, as far as it says."""
    import zoneinfo
    from pathlib import Path

    for folder in zoneinfo.TZPATH:
        for name in ("+VERSION", "tzdata.zi", "version"):
            p = Path(folder, name)
            if p.is_file():
                head = p.open().readline().strip()
                return head.removeprefix("# version ")
    return "unknown"


def local_to_utc(local: np.ndarray, zone_ids: np.ndarray, names: list[str | None], tables: dict) -> np.ndarray:
    """UTC microseconds of local microseconds; INVALID where the zone is unknown."""
    out = np.full(len(local), INVALID, dtype=np.int64)
    for k in np.unique(zone_ids):
        at = np.nonzero(zone_ids == k)[0]
        name = names[k]
        if name in ("UTC", None):
            if name:
                out[at] = local[at]
            continue
        if name in tables["zones"]:
            switches, offsets = tables["zones"][name]
            out[at] = local[at] - offsets[np.searchsorted(switches, local[at], side="right")]
            first, last = tables["span"]
            for i in at[(local[at] < first) | (local[at] >= last)].tolist():
                out[i] = _local_to_utc_outside(int(local[i]), name)
    return out


def _local_to_utc_outside(local: int, name: str) -> int:
    """One local time by the zone's own rules; INVALID beyond the years 1 to 9999."""
    from zoneinfo import ZoneInfo

    try:
        then = datetime(1970, 1, 1) + timedelta(microseconds=local)
    except OverflowError:
        return INVALID
    return local - round(then.replace(tzinfo=ZoneInfo(name)).utcoffset().total_seconds() * SECOND)


def to_utc_micros(values: pa.Array, zones: pa.Array, month_first: np.ndarray, tables: dict) -> np.ndarray:
    """UTC microseconds of date texts; INVALID for null, blank or unusable ones.

    zones names the zone of each text that has none of its own ('UTC' or an IANA name);
    month_first tells for each text whether slashes put the month first.
    """
    n = len(values)
    out = np.full(n, INVALID, dtype=np.int64)
    if n == 0:
        return out
    values = pc.utf8_trim_whitespace(pc.fill_null(values, ""))
    values = pc.replace_substring_regex(values, " | ", " ")
    masks = shape_masks(values).dictionary_encode()
    codes = masks.indices.to_numpy(zero_copy_only=False)
    zcol = zones.dictionary_encode()
    znames = [*zcol.dictionary.to_pylist(), None]
    zcodes = pc.fill_null(zcol.indices, len(znames) - 1).to_numpy(zero_copy_only=False)
    by_family: dict[tuple[str, str | None], list[int]] = {}
    for code, mask in enumerate(masks.dictionary.to_pylist()):
        by_family.setdefault(parser_of(mask), []).append(code)
    for (family, pattern), own in by_family.items():
        if family == "none":
            continue
        at = np.nonzero(np.isin(codes, own))[0]
        part = values.take(pa.array(at))
        if family == "digits":
            out[at] = _digits(part, zcodes[at], znames, tables)
            continue
        g = pc.extract_regex(part, pattern)
        hit = pc.is_valid(g).to_numpy(zero_copy_only=False)
        if not hit.all():
            at, g = at[hit], g.filter(pa.array(hit))
        if not len(at):
            continue
        names = {g.type.field(i).name for i in range(g.type.num_fields)}
        f = lambda k, missing=0: _ints(g.field(k), missing) if k in names else np.full(len(at), missing, dtype=np.int64)  # noqa: E731, B023
        y = f("y")
        if family == "slash":
            a, b = f("a"), f("b")
            first = month_first[at]
            m, d = np.where(first, a, b), np.where(first, b, a)
        else:
            d = f("d")
            m = _lookup(g.field("n"), _fold_month) if "n" in names else f("m")
        days, ok = _days(y, m, d)
        hours, minutes, seconds = f("H"), f("M"), f("S")
        if "p" in names:
            half = _lookup(g.field("p"), lambda p: {"a": 1, "p": 2}.get(p[:1].lower(), 0))
            ok &= (half == 0) | ((hours >= 1) & (hours <= 12))
            hours = np.where(half > 0, hours % 12 + 12 * (half == 2), hours)
        ok &= (hours <= 23) & (minutes <= 59) & (seconds <= 59)
        frac = _ints(pc.utf8_slice_codeunits(pc.utf8_rpad(g.field("f"), 6, "0"), 0, 6))
        local = ((days * 24 + hours) * 60 + minutes) * 60 * SECOND + seconds * SECOND + frac
        offset = _lookup(g.field("z"), _offset_minutes)
        own_zone = offset < NO_ZONE
        ok &= offset != BAD_ZONE
        utc = np.where(own_zone, local - np.where(own_zone, offset, 0) * 60 * SECOND, 0)
        rest = np.nonzero(~own_zone)[0]
        utc[rest] = local_to_utc(local[rest], zcodes[at][rest], znames, tables)
        out[at] = np.where(ok, utc, INVALID)
    return out


def _digits(part: pa.Array, zcodes: np.ndarray, znames: list, tables: dict) -> np.ndarray:
    lengths = pc.utf8_length(part).to_numpy(zero_copy_only=False)
    out = np.full(len(part), INVALID, dtype=np.int64)
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        what = DIGITS[int(n)]
        own = part.take(pa.array(at))
        fits = pc.less_equal(own, LARGEST).to_numpy(zero_copy_only=False) if n == len(LARGEST) else np.ones(len(at), dtype=bool)
        if not fits.all():  # more than any count can be
            at, own = at[fits], own.filter(pa.array(fits))
        number = pc.cast(own, pa.int64()).to_numpy(zero_copy_only=False)
        if what != "calendar":
            out[at] = number * what if what > 0 else number // -what
            continue
        number = number * 10 ** (14 - int(n))
        s, number = number % 100, number // 100
        mi, number = number % 100, number // 100
        h, number = number % 100, number // 100
        days, ok = _days(number // 10000, number // 100 % 100, number % 100)
        ok &= (h <= 23) & (mi <= 59) & (s <= 59)
        local = ((days * 24 + h) * 60 + mi) * 60 * SECOND + s * SECOND
        out[at] = np.where(ok, local_to_utc(local, zcodes[at], znames, tables), INVALID)
    return out


def iso_micros(utc: np.ndarray) -> pa.Array:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of each instant, null where INVALID."""
    ok = (utc > -62_135_596_800 * SECOND) & (utc < 253_402_300_800 * SECOND)
    text = np.datetime_as_string(np.where(ok, utc, 0).astype("datetime64[us]"), unit="us")
    return pa.array(np.char.add(text, "Z"), type=pa.string(), mask=~ok)
