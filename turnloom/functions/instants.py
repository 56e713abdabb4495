"""Timestamps in mixed formats to microseconds in UTC, vectorised by shape.

Each text is reduced to a mask of character classes.  A distinct mask is planned once: its digit runs,
words and signs are laid out, the words are classified (month, weekday, half of the day, zone, filler)
and the resulting shape is matched against the known arrangements.  All texts of one mask are then
converted together by slicing a matrix of code points.  Wall times go through transition tables built
from the installed zone data, whose content hash is their version.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np

# English month and weekday names (three letters or whole).
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
FILLERS = ["at", "on", "of", "the", "um", "de", "le"]
# Zone abbreviations in hours from UTC, North American and Central European.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0,
    "nst": -3.5, "ndt": -2.5, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6,
    "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10, "cet": 1, "cest": 2, "mez": 1, "mesz": 2,
}

NONE, INSTANT, WALL = 0, 1, 2
SECOND, HOUR = 1_000_000, 3_600_000_000
#: Years whose transitions are tabulated; times outside them ask the zone itself.
YEARS = (1900, 2100)
#: Shapes longer than this are laid out without being remembered.
REMEMBERED_SHAPE = 200


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = got = "9" if "0" <= c <= "9" else "A" if c.isalpha() else " " if c.isspace() else c
        return got


_CLASSES = _Classes()


def mask(text: str) -> str:
    """Character-class mask: digits 9, letters A, white space blank, all else itself."""
    return text.translate(_CLASSES)


def _word_class(word: str) -> tuple[str, float]:
    w = word.lower()
    for names, kind in ((MONTHS, "M"), (WEEKDAYS, "W")):
        for k, name in enumerate(names):
            if w in (name, name[:3]) or (len(w) == 4 and name.startswith(w)):
                return kind, k + 1
    if w in ("am", "pm"):
        return "P", 12.0 * (w == "pm")
    if w == "t":
        return "T", 0
    if w in ABBREVIATIONS:
        return "Z", ABBREVIATIONS[w]
    return ("F", 0) if w in FILLERS else ("X", 0)


_TIME = r"(?P<H>99?):(?P<I>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<p>P))?"
_TIGHT = r"(?P<H>99)(?P<I>99)(?P<S>99)?(?:[.,](?P<f>9+))?"
_ZONE = r"(?: ?(?P<z>Z)?(?:(?P<sign>[+-])(?P<oh>99?)(?::?(?P<om>99))?)?)?(?: ?\[?(?P<r>R)\]?)?"
_DATES = [
    r"(?P<y>9999)(?P<s1>[-/.])(?P<m>99?)(?P=s1)(?P<d>99?)",
    r"(?P<a>99?)(?P<s1>[-/.])(?P<b>99?)(?P=s1)(?P<y>9999)",
    r"(?P<mon>M)\.? (?P<d>99?),? (?P<y>9999)",
    r"(?P<d>99?)[ -](?P<mon>M)\.?,?[ -](?P<y>9999)",
]
_GLUE = r"(?:T| |, | F |, F )"
_SHAPES = [re.compile(rf"(?:W\.?,? )?{d}(?: ?\(W\))?{_GLUE}{_TIME}{_ZONE}") for d in _DATES]
_SHAPES += [re.compile(rf"(?:W\.?,? )?{_TIME}{_ZONE}{_GLUE}(?:W\.?,? )?{d}(?: ?\(W\))?") for d in _DATES]
_SHAPES += [re.compile(rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?:T| )?{_TIGHT}{_ZONE}"), re.compile(rf"(?P<y>9999)-(?P<m>99)-(?P<d>99)T{_TIGHT}{_ZONE}")]
_EPOCH = re.compile(r"(?P<neg>-)?(?P<n>9{9,19})(?:\.(?P<f>9+))?")
_WORDS = re.compile(r"(?<=\[)A+(?:[/_-]A+)*(?=\])|A+(?:[_-]A+)*/A+(?:[/_-]A+)*|A+")


@lru_cache(maxsize=8192)
def _layout(shape: str) -> tuple[str, dict] | None:
    """Fields of a shape as spans, or None where no arrangement fits. Called once per distinct shape."""
    if got := _EPOCH.fullmatch(shape):
        return "epoch", {k: got.span(k) for k in got.groupdict() if got[k] is not None}
    for pattern in _SHAPES:
        if got := pattern.fullmatch(shape):
            return "civil", {k: got.span(k) for k in got.groupdict() if got[k] is not None}
    return None


@lru_cache(maxsize=8192)
def _tokens(of: str) -> tuple:
    """Words of a mask as (start, end, is a zone name), in order."""
    return tuple((m.start(), m.end(), "/" in m[0] or of[m.start() - 1 : m.start()] == "[") for m in _WORDS.finditer(of))


@lru_cache(maxsize=1024)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Transition table of a zone: instants (µs) and the offset (µs) from each on; None if unknown."""
    try:
        zone = ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any unusable name
        return None

    def offset(second: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    day = 86_400
    first, last = ((datetime(y, 1, 2, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).days * day for y in YEARS)
    at, offsets, t, now = [-(1 << 61)], [offset(first)], first, offset(first)
    while t < last:
        if (then := offset(t + 5 * day)) != now:
            low, high = t, t + 5 * day
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == now else (low, mid)
            now = offset(high)
            at.append(high * SECOND)
            offsets.append(now)
            t = high
        else:
            t += 5 * day
    return np.array(at, "i8"), np.array(offsets, "i8") * SECOND


def zone_version(names: list[str]) -> str:
    """Content hash of the transition tables of ``names``: equal versions convert alike."""
    h = hashlib.sha256()
    for n in sorted(names):
        if (t := zone_table(n)) is not None:
            h.update(n.encode() + t[0].tobytes() + t[1].tobytes())
    return h.hexdigest()[:16]


_EDGES = [int((datetime(y, 1, 3, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * SECOND for y in YEARS]


def _outside(us: np.ndarray) -> np.ndarray:
    return np.flatnonzero((us < _EDGES[0]) | (us > _EDGES[1]))


def _asked(us: int, zone: ZoneInfo, wall: bool) -> list[int]:
    """Offsets (µs) that a zone itself gives a wall time (none, one or two), or an instant (one); none outside the calendar."""
    try:
        day = datetime(1970, 1, 1) + timedelta(microseconds=int(us))
        if not wall:
            return [int(day.replace(tzinfo=UTC).astimezone(zone).utcoffset() / timedelta(microseconds=1))]
        ways = {day.replace(tzinfo=zone, fold=f).utcoffset() for f in (0, 1)}
        return [int(w / timedelta(microseconds=1)) for w in ways if (day - w).replace(tzinfo=UTC).astimezone(zone).replace(tzinfo=None) == day]
    except OverflowError:
        return []


def offsets_at(us: np.ndarray, name: str) -> np.ndarray:
    """Offset (µs) of a zone at instants, by table, outside it by the zone itself."""
    at, offsets = zone_table(name)
    out = offsets[np.searchsorted(at, us, side="right") - 1].copy()
    for i in _outside(us):
        out[i] = (_asked(us[i], ZoneInfo(name), False) or [0])[0]
    return out


def wall_to_utc(wall: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC of wall times in a zone and whether each happened exactly once."""
    table = zone_table(name)
    if table is None:
        return np.zeros(len(wall), "i8"), np.zeros(len(wall), bool)
    at, offsets = table
    found, out = np.zeros(len(wall), "i8"), np.zeros(len(wall), "i8")
    near = np.clip(np.searchsorted(at, wall) - 1, 0, len(at) - 1)
    for off in np.unique(offsets[np.unique(np.clip(near[:, None] + np.arange(-2, 3), 0, len(at) - 1))]):
        utc = wall - off
        fits = offsets[np.searchsorted(at, utc, side="right") - 1] == off
        out = np.where(fits, utc, out)
        found += fits
    for i in _outside(wall):
        ways = _asked(wall[i], ZoneInfo(name), True)
        found[i], out[i] = len(ways), wall[i] - (ways or [0])[0]
    return out, found == 1


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (m >= 1) & (m <= 12) & (y >= 1) & (d >= 1)
    month = ((y - 1970) * 12 + np.where(ok, m, 1) - 1).astype("M8[M]")
    start = month.astype("M8[D]")
    ok &= start.astype("i8") + d - 1 < (month + 1).astype("M8[D]").astype("i8")
    return start.astype("i8") + d - 1, ok


def parse(texts: list) -> dict[str, np.ndarray]:
    """kind (NONE, INSTANT, WALL), us and us_dmy (month or day first where both are numbers), ok of both, zone.

    Runs of white space count as one blank; no length rules a text out, only its shape does.  Null, empty and
    unusable texts have kind NONE.  ``zone`` holds a zone named in the text, or None.
    """
    n = len(texts)
    out = {"kind": np.zeros(n, "i1"), "us": np.zeros(n, "i8"), "us_dmy": np.zeros(n, "i8"), "ok": np.zeros(n, bool), "ok_dmy": np.zeros(n, bool), "zone": np.full(n, None, object)}
    groups: dict[str, list[int]] = {}
    clean = [None if t is None else " ".join(t.split()) for t in texts]
    for i, t in enumerate(clean):
        if t:
            groups.setdefault(mask(t), []).append(i)
    for of, rows in groups.items():
        if "9" in of:
            _convert(of, np.array(rows), [clean[i] for i in rows], out)
    return out


def _convert(of: str, rows: np.ndarray, texts: list[str], out: dict[str, np.ndarray]) -> None:
    codes = np.array(texts, f"U{len(of)}").view("u4").reshape(len(texts), len(of))
    words, keys = [], np.full(len(texts), "", object)
    for start, end, named in (_tokens if len(of) <= REMEMBERED_SHAPE else _tokens.__wrapped__)(of):
        column = np.ascontiguousarray(codes[:, start:end]).view(f"U{end - start}").ravel()
        values, at = np.unique(column, return_inverse=True)
        classes = [("R", 0.0) if named else _word_class(str(v)) for v in values]
        words.append((start, end, values, at, np.array([c[1] for c in classes])))
        kinds = np.array([ord(c[0]) for c in classes])[at]
        keys = np.array([k + chr(c) for k, c in zip(keys, kinds)], object)
    for key in set(keys):
        pick = np.flatnonzero(keys == key)
        shape, position, last = "", [], 0
        for (start, end, *_), letter in zip(words, key):
            position += range(last, start)
            shape += of[last:start] + letter
            position.append(start)
            last = end
        shape += of[last:]
        position += [*range(last, len(of)), len(of)]
        if (plan := (_layout if len(shape) <= REMEMBERED_SHAPE else _layout.__wrapped__)(shape)) is None:
            continue
        fields = {f: (position[a], position[b - 1] + 1) for f, (a, b) in plan[1].items()}
        _fill(plan[0], fields, rows[pick], codes[pick], {w[0]: (w[2], w[3][pick], w[4]) for w in words}, out)


def _fill(form: str, fields: dict, rows: np.ndarray, codes: np.ndarray, words: dict, out: dict[str, np.ndarray]) -> None:
    def number(f: str, default: int = 0) -> np.ndarray:
        if f not in fields:
            return np.full(len(rows), default, "i8")
        a, b = fields[f]
        return (codes[:, a:b].astype("i8") - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype="i8"))

    def word(f: str) -> np.ndarray:
        _, at, numbers = words[fields[f][0]]
        return numbers[at]

    def fraction() -> np.ndarray:
        if "f" not in fields:
            return number("none")
        a, b = fields["f"]
        b = min(b, a + 6)
        return ((codes[:, a:b].astype("i8") - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype="i8"))) * 10 ** (6 - (b - a))

    if form == "epoch":
        a, b = fields["n"]
        digits = b - a
        value = number("n")
        us = value * SECOND + fraction() if digits <= 11 else value * 1000 if digits <= 14 else value if digits <= 17 else value // 1000
        out["kind"][rows], out["ok"][rows], out["ok_dmy"][rows] = INSTANT, True, True
        out["us"][rows] = out["us_dmy"][rows] = -us if "neg" in fields else us
        return
    hour, minute, second = number("H"), number("I"), number("S")
    ok = (minute < 60) & (second < 60)
    if "p" in fields:
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + word("p").astype("i8")
    else:
        ok &= hour < 24
    clock = ((hour * 60 + minute) * 60 + second) * SECOND + fraction()
    year = number("y")
    if "a" in fields:
        a, b = number("a"), number("b")
        orders = [(b, a)] * 2 if chr(int(codes[0, fields["s1"][0]])) == "." else [(a, b), (b, a)]  # dotted dates are day first everywhere
    else:
        m = word("mon").astype("i8") if "mon" in fields else number("m")
        orders = [(m, number("d"))] * 2
    kind = WALL
    shift = np.zeros(len(rows), "i8")
    if "z" in fields or "sign" in fields:
        kind = INSTANT
        if "z" in fields:
            shift = shift + (word("z") * HOUR).astype("i8")
        if "sign" in fields:
            ok &= (number("oh") <= 15) & (number("om") < 60)
            plus = np.where(codes[:, fields["sign"][0]] == ord("-"), -1, 1)
            shift = shift + plus * (number("oh") * 60 + number("om")) * 60 * SECOND
    if "r" in fields:
        values, at, _ = words[fields["r"][0]]
        out["zone"][rows] = values[at].astype(object)
    out["kind"][rows] = kind
    for (m, d), us_name, ok_name in zip(orders, ("us", "us_dmy"), ("ok", "ok_dmy")):
        days, fits = _days(year, m, d)
        out[us_name][rows] = days * 86_400 * SECOND + clock - shift
        out[ok_name][rows] = ok & fits


def to_utc(texts: list, home_zones: list, date_styles: list) -> np.ndarray:
    """Microseconds in UTC as floatless objects: int64 where the text denotes one instant, else None.

    A zone or offset in the text goes before ``home_zones``; an offset that its own zone name contradicts
    denotes nothing.  ``date_styles`` ('mdy', 'dmy' or null) settles days and months that are both numbers;
    without a style only dates that read alike, or one way only, count.
    """
    p = parse(texts)
    style = np.array(date_styles, object)
    dmy = style == "dmy"
    us, ok = np.where(dmy, p["us_dmy"], p["us"]), np.where(dmy, p["ok_dmy"], p["ok"])
    loose = (style != "dmy") & (style != "mdy")
    swap = loose & ~p["ok"] & p["ok_dmy"]
    us, ok = np.where(swap, p["us_dmy"], us), ok | swap
    ok &= ~(loose & p["ok"] & p["ok_dmy"] & (p["us"] != p["us_dmy"]))
    named = np.array([z is not None for z in p["zone"]], bool)
    zones = np.where(named, p["zone"], np.array(home_zones, object))
    wall = (p["kind"] == WALL) & ok
    good = (p["kind"] == INSTANT) & ok
    checked = good & named
    for group in ("wall", "checked"):
        rows = np.flatnonzero(wall if group == "wall" else checked)
        if not len(rows):
            continue
        names = np.array([z if isinstance(z, str) else "" for z in zones[rows]])
        for name in np.unique(names):
            at = rows[names == name]
            if group == "wall":
                us[at], good[at] = wall_to_utc(us[at], str(name)) if name else (0, False)
            elif zone_table(str(name)) is None:
                good[at] = False
            else:
                shift = offsets_at(us[at], str(name))
                raw = np.array([_offset_of(texts[i]) for i in at], "i8")
                good[at] = shift == raw
    out = np.full(len(texts), None, object)
    out[good] = us[good]
    return out


def _offset_of(text: str) -> int:
    """Offset (µs) written before a bracketed zone name."""
    got = re.search(r"([+-])(\d\d):?(\d\d)?\s*\[", text)
    return 0 if got is None else (-1 if got[1] == "-" else 1) * (int(got[2]) * 60 + int(got[3] or 0)) * 60 * SECOND
