"""Parsers of landed payloads in plain Python: HTML and its scripts, iCalendar, prices and titles.

Each takes text and returns plain values, so that they can be tested alone and
run in pandas UDFs or mapInPandas over whole partitions.
"""

from __future__ import annotations

import html
import json
import re
from datetime import datetime, timedelta
from html.parser import HTMLParser
from zoneinfo import ZoneInfo

from ..functions.text import fold_py
from ..functions.times import PARIS

ZONE_UTC = ZoneInfo("UTC")

# ---------------------------------------------------------------- text and HTML


class _Text(HTMLParser):
    BLOCKS = {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "article", "section"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def clean_text(raw: str | None) -> str:
    """HTML or escaped text as plain text, one space apart, lines kept."""
    if not raw:
        return ""
    p = _Text()
    p.feed(raw)
    p.close()
    text = "".join(p.out)
    for _ in range(2):  # entities that were escaped twice
        text = html.unescape(text)
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


class _Scripts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[dict, str]] = []
        self.open: tuple[dict, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "script":
            self.open = (dict(attrs), [])

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self.open:
            self.found.append((self.open[0], "".join(self.open[1])))
            self.open = None


def scripts(page: str) -> list[tuple[dict, str]]:
    p = _Scripts()
    p.feed(page or "")
    p.close()
    return p.found


def lenient_json(text: str):
    """JSON with HTML comments around it, control characters in strings, or commas too many; None if it is none."""
    text = re.sub(r"<!--|-->", "", text).strip().rstrip(";")
    for t in (text, re.sub(r",\s*([}\]])", r"\1", text)):
        try:
            return json.loads(t, strict=False)
        except ValueError:
            continue
    return None


def embedded_json(page: str, name: str):
    """The object assigned to a variable, or in a script of an id (``__NEXT_DATA__`` and the like)."""
    for attrs, body in scripts(page):
        if attrs.get("id") == name:
            return lenient_json(body)
        m = re.search(rf"{re.escape(name)}\s*=\s*(\{{.*)", body, re.S)
        if m:
            try:
                return json.JSONDecoder(strict=False).raw_decode(m[1])[0]
            except ValueError:
                return None
    return None


def links(xml: str) -> list[str]:
    """Locations of a sitemap."""
    return [html.unescape(x.strip()) for x in re.findall(r"<loc>\s*(.*?)\s*</loc>", xml or "", re.S)]


# ---------------------------------------------------------------- iCalendar


def ics_events(text: str) -> list[dict]:
    """VEVENTs: folded lines joined, zones and dates read, an all-day end made inclusive; rules are not expanded."""
    lines = re.sub(r"\r?\n[ \t]", "", text or "").splitlines()
    out, now, inner = [], None, 0
    for line in lines:
        if line == "BEGIN:VEVENT":
            now, inner = {}, 0
        elif line == "END:VEVENT" and now is not None:
            out.append(_ics(now))
            now = None
        elif now is not None and line.startswith(("BEGIN:", "END:")):  # a block inside, such as an alarm
            inner += 1 if line.startswith("BEGIN:") else -1
        elif now is not None and not inner and ":" in line:
            head, _, value = line.partition(":")
            name, *params = head.split(";")
            now.setdefault(name.upper(), (dict(p.split("=", 1) for p in params if "=" in p), value))
    return out


def _unescaped(v: str) -> str:
    return re.sub(r"\\([\;,nN])", lambda m: "\n" if m[1] in "nN" else m[1], v)


def _ics_time(entry) -> tuple[datetime | None, bool]:
    """(UTC instant, whether it is a whole day)."""
    if entry is None:
        return None, False
    params, v = entry
    if params.get("VALUE") == "DATE" or re.fullmatch(r"\d{8}", v):
        return datetime.strptime(v[:8], "%Y%m%d").replace(hour=12, tzinfo=PARIS), True
    m = re.fullmatch(r"(\d{8}T\d{6})(Z?)", v)
    if not m:
        return None, False
    t = datetime.strptime(m[1], "%Y%m%dT%H%M%S")
    try:
        zone = ZoneInfo("UTC") if m[2] else ZoneInfo(params.get("TZID", "Europe/Paris"))
    except Exception:  # noqa: BLE001  an unknown zone reads as local time
        zone = PARIS
    return t.replace(tzinfo=zone), False


def _ics(e: dict) -> dict:
    get = lambda k: _unescaped(e[k][1]).strip() or None if k in e else None
    start, whole = _ics_time(e.get("DTSTART"))
    end, _ = _ics_time(e.get("DTEND"))
    if end and whole:
        end = (end - timedelta(days=1)).replace(hour=23, minute=59)
    geo = re.fullmatch(r"\s*(-?[\d.]+)\s*;\s*(-?[\d.]+)\s*", get("GEO") or "")
    utc = lambda t: t.astimezone(ZONE_UTC).replace(tzinfo=None) if t else None
    return {"uid": get("UID"), "title": clean_text(get("SUMMARY")) or None, "start_date": utc(start), "end_date": utc(end), "time_known": start is not None and not whole, "venue_name": get("LOCATION"), "description": get("DESCRIPTION"), "url": get("URL"), "lat": float(geo[1]) if geo else None, "lng": float(geo[2]) if geo else None, "is_cancelled": get("STATUS") == "CANCELLED", "tags": [x.strip() for x in (get("CATEGORIES") or "").split(",") if x.strip()]}


# ---------------------------------------------------------------- numbers and prices


def _number(x) -> float | None:
    try:
        return float(str(x).replace(",", "."))
    except (TypeError, ValueError):
        return None


def cents(x, most: int = 100_000) -> int | None:
    """An amount in euros as cents, half to even; None if it is none or out of range."""
    from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation

    try:
        v = Decimal(str(x).replace(" ", "").replace(" ", "").replace(",", "."))
        c = int((v * 100).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))
    except (InvalidOperation, ValueError):
        return None
    return c if 0 <= c <= most else None


def price(text: str | None) -> dict:
    """min, max (cents), is_free and status of a French price text."""
    t = fold_py(clean_text(text)).replace(" ", " ")
    t = re.sub(r"\b(19|20)\d\d\b(?!\s*(€|eur))", " ", t)
    amounts = [c for a, b in re.findall(r"(\d+(?:[.,]\d{1,2})?)\s*(?:€|euros?|eur)|(?:€|eur)\s*(\d+(?:[.,]\d{1,2})?)", t) if (c := cents(a or b)) is not None]
    m = re.search(r"(?:de\s+)?(\d+(?:[.,]\d{1,2})?)\s*(?:a|-|/)\s*(\d+(?:[.,]\d{1,2})?)\s*(?:€|euros?|eur)", t)
    if m:
        amounts += [c for x in m.groups() if (c := cents(x)) is not None]
    free = bool(re.search(r"\b(gratuit|gratuite|entree libre|acces libre|free)\b", t))
    if free and not [a for a in amounts if a]:
        return {"min": 0, "max": 0, "is_free": True, "status": "free"}
    if not amounts:
        return {"min": 0, "max": 0, "is_free": False, "status": "unknown"}
    low = 0 if free else min(amounts)
    if max(amounts) == 0:
        return {"min": 0, "max": 0, "is_free": True, "status": "free"}
    return {"min": low, "max": max(amounts), "is_free": False, "status": "paid"}


# ---------------------------------------------------------------- titles

# Words that stay small inside a title, those that stay in capitals, what is left out before an apostrophe, and what a word begins after.
_SMALL = set("de du des la le les et à a au aux en sur pour par dans avec sans un une ou chez vs the of and or in on at to for with by from an y d l".split())
_CAPITALS = set(
    "DJ MC UGC MK2 USA UK NYC RER SNCF RATP BD VO VF VOST VOSTFR OST IA AI LGBT LGBTQ LGBTQIA TV CD LP EP PSG BNF MJC CNSMD R&B RNB OK KO SOS FM XXL XL BBC ONU UE VIP NBA NFL WWE MMA ABBA AC/DC ACDC UB40 BTS PNL SCH JUL IAM NTM MGMT LCD XX CNRS EDF IRCAM ADN UFO".split()
)
_ELIDED = set("l d j n s c qu jusqu lorsqu puisqu".split())
_OPENERS = "–—(\"«:|/."
_VOWELS = set("AEIOUYÀÂÄÉÈÊËÎÏÔÖÙÛÜŸ")
_TITLE_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


def _shouts(title: str) -> bool:
    letters = [x for x in title if x.isalpha()]
    return len(letters) > 4 and sum(x.isupper() for x in letters) > 0.7 * len(letters)


def _in_capitals(word: str) -> bool:
    """Acronyms, Roman numerals up to 89, words with digits, and two to four letters without a vowel."""
    letters = [x for x in word if x.isalpha()]
    roman = re.fullmatch("L?X{0,3}(?:IX|IV|V?I{0,3})", word)
    return word in _CAPITALS or bool(roman) or 0 < len(letters) < sum(x.isalnum() for x in word) or 1 < len(letters) < 5 and not _VOWELS.intersection(letters)


def _titled(word: str, leads: bool) -> str:
    if _in_capitals(word.upper()):
        return word.upper()
    low = word.lower()
    before, mark, rest = next(((low[:i], low[i], low[i + 1 :]) for i, x in enumerate(low) if x in "'’"), ("", "", ""))
    if mark and rest and before in _ELIDED:
        return (before.capitalize() if leads else before) + mark + _titled(rest, True)
    return low if low in _SMALL and not leads else low[:1].upper() + low[1:]


def title_case(title: str) -> str:
    """A title that shouts (over 70 % capitals of more than four letters) in title case: small words small but at the start of a part, elisions before a capital, acronyms as they are. Any other stays."""
    if not _shouts(title):
        return title
    begin = next((m.start() for m in _TITLE_WORD.finditer(title)), 0)
    return _TITLE_WORD.sub(lambda m: _titled(m[0], m.start() == begin or title[m.start() - 1] in _OPENERS), title)


def title_artists(title: str, most: int = 20) -> list[str]:
    """Names in a line-up title: parts between '+', '/', 'x', 'feat.' and the like."""
    head = re.split(r"\s[-–—|:]\s", " ".join(title.split()))[0]
    parts = re.split(r"\s*(?:\+|/|&|,|\bfeat\.?|\bft\.?|\bwith\b|\bavec\b|\sx\s)\s*", head, flags=re.I)
    return [p.strip() for p in parts if 2 <= len(p.strip()) <= 80][:most]
