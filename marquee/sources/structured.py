"""Events that pages describe in JSON-LD or microdata.

Python takes the descriptions out of the HTML, as JSON; what they say is read from variants by built-in functions,
since any property may be a value, an object or a list of either.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import clean_text, lenient_json, scripts

# Types of events, in lower case, and what they say of a category.
EVENT_TYPES = (
    "event", "musicevent", "theaterevent", "screeningevent", "exhibitionevent", "danceevent", "comedyevent", "festival", "educationevent", "socialevent",
    "visualartsevent", "childrensevent", "literaryevent", "publicationevent", "eventseries", "foodevent", "courseinstance",
)
CATEGORY_OF_TYPE = {"musicevent": "concerts", "theaterevent": "theatre", "screeningevent": "cinema", "exhibitionevent": "expos", "visualartsevent": "expos", "danceevent": "danse", "comedyevent": "spectacles", "festival": "festivals", "literaryevent": "conferences", "educationevent": "ateliers", "courseinstance": "ateliers"}
# Properties that lead to further events, and how deep.
HOLDERS = ("@graph", "itemListElement", "item", "subEvent", "event")
DEEPEST = 6


def _is_event(value: dict) -> bool:
    kinds = value.get("@type")
    return any(str(k).rsplit("/", 1)[-1].lower() in EVENT_TYPES for k in (kinds if isinstance(kinds, list) else [kinds]))


def described(document) -> Iterator[dict]:
    """The events of a JSON-LD document, level by level."""
    level = deque([(document, 0)])
    while level:
        value, deep = level.popleft()
        if isinstance(value, dict):
            if _is_event(value):
                yield value
            inside = [value[k] for k in HOLDERS if k in value]
        else:
            inside = value if isinstance(value, list) else []
        if deep < DEEPEST:
            level.extend((x, deep + 1) for x in inside)


def jsonld_objects(page: str) -> list[dict]:
    """Event objects in the scripts of a page; equal names, starts and addresses once."""
    found: dict[tuple, dict] = {}
    for attributes, body in scripts(page):
        if "ld+json" in (attributes.get("type") or ""):
            for event in described(lenient_json(body)):
                found.setdefault(tuple(json.dumps(event.get(k)) for k in ("name", "startDate", "url")), event)
    return list(found.values())


class _Micro(HTMLParser):
    VOID = {"meta", "link", "img", "br", "input", "hr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict | None, str | None, list[str]]] = []
        self.top: list[dict] = []

    def _scope(self) -> dict | None:
        return next((s for _, s, _, _ in reversed(self.stack) if s is not None), None)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        prop, outer = a.get("itemprop"), self._scope()
        scope = {"@type": (a.get("itemtype") or "").rsplit("/", 1)[-1]} if "itemscope" in a else None
        if scope is not None and outer is None:
            self.top.append(scope)
        elif scope is not None and prop and outer is not None:
            outer.setdefault(prop, scope)
        value = a.get("content") or a.get("datetime") or (a.get("href") or a.get("src") if prop in ("url", "image") else None)
        if prop and scope is None and outer is not None and value:
            outer.setdefault(prop, value)
            prop = None
        if tag not in self.VOID:
            self.stack.append((tag, scope, prop if scope is None else None, []))

    def handle_data(self, data):
        for _, _, prop, parts in self.stack:
            if prop:
                parts.append(data)

    def handle_endtag(self, tag):
        while self.stack:
            t, _, prop, parts = self.stack.pop()
            outer = self._scope()
            if prop and outer is not None:
                outer.setdefault(prop, " ".join("".join(parts).split()))
            if t == tag:
                break


def microdata_objects(page: str) -> list[dict]:
    """Event objects that the attributes of a page describe."""
    reader = _Micro()
    reader.feed(page or "")
    reader.close()
    return [x for x in reader.top if _is_event(x)]


def _plain(event: dict) -> str:
    """JSON of an event with its texts cleaned of markup."""
    texts = {k: clean_text(event[k]) for k in ("name", "description") if isinstance(event.get(k), str)}
    return json.dumps(event | texts)


def objects(pages: DataFrame, key: str, value: str, find: Callable[[str], list[dict]]) -> DataFrame:
    """(key, event as a variant) of every event object of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, _plain(x)) for k, v in zip(pdf[key], pdf[value], strict=True) for x in find(v or "")]
            yield pd.DataFrame(rows, columns=[key, "json"], dtype=object)

    return pages.select(key, value).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, json string").select(key, F.try_parse_json("json").alias("event"))


# ---------------------------------------------------------------- what an event object says


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}" if path[0] not in "[" else f"${path}", "variant")


def _one(v: Column) -> Column:
    """The first element of a list; anything else itself."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), _at(v, "[0]")).otherwise(v)


def _many(v: Column) -> Column:
    """The elements of a list; anything else as the only one; nothing as none."""
    return F.when(v.isNull(), F.array().cast("array<variant>")).when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def _string(v: Column) -> Column:
    """A string or number as text; null for an object, a list or an empty text."""
    scalar = F.when(~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT|VOID)"), F.try_variant_get(v, "$", "string"))
    return F.nullif(F.trim(scalar), F.lit(""))


def _named(v: Column) -> Column:
    """An object's name, or the text itself."""
    return F.coalesce(_string(_one(_at(v, "name"))), _string(v))


def _kinds(v: Column) -> Column:
    return F.transform(_many(_at(v, "['@type']")), lambda x: F.lower(F.element_at(F.split(_string(x), "/"), -1)))


def _number(v: Column) -> Column:
    return F.replace(_string(v), F.lit(","), F.lit(".")).try_cast("double")


def cents(text: Column) -> Column:
    """An amount in euros as cents, half to even; null if it is none or above a thousand euros."""
    amount = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[\s\u00a0]", "").try_cast("decimal(12,4)")
    c = F.bround(amount * 100, 0).cast("long")
    return F.when(c.between(0, 100_000), c.cast("int"))


def _prices(event: Column) -> Column:
    """Cents of all offers in euros."""

    def of(offer: Column) -> Column:
        euro = F.coalesce(_string(_at(offer, "priceCurrency")), F.lit("EUR")) == "EUR"
        found = F.array_compact(F.array(*(cents(_string(_at(offer, k))) for k in ("price", "lowPrice", "highPrice"))))
        return F.when(euro, found).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(_many(_at(event, "offers")), of))


def rows(found: DataFrame, key: str) -> DataFrame:
    """Raw events of objects(): one row an event."""
    e = F.col("event")
    place = _one(_at(e, "location"))
    address = _one(_at(place, "address"))
    image = _one(_at(e, "image"))
    staged = found.withColumns({"_place": place, "_address": address, "_geo": _at(place, "geo"), "_image": image, "_prices": _prices(e)})
    place, address, geo, image = (F.col(c) for c in ("_place", "_address", "_geo", "_image"))
    online = F.coalesce(F.exists(_kinds(place), lambda k: k == "virtuallocation"), F.lit(False)) | F.coalesce(F.contains(_string(_at(e, "eventAttendanceMode")), F.lit("Online")), F.lit(False))
    categories = F.create_map(*(F.lit(x) for kv in CATEGORY_OF_TYPE.items() for x in kv))
    return staged.select(
        key, _string(_at(e, "name")).alias("title"), _string(_one(_at(e, "url"))).alias("url"), _string(_at(e, "startDate")).alias("start_date"), _string(_at(e, "endDate")).alias("end_date"), _string(_at(e, "description")).alias("description"),
        F.coalesce(_string(_one(_at(image, "url"))), _string(image)).alias("image_url"), _named(place).alias("venue_name"), F.coalesce(_string(_at(address, "streetAddress")), _string(address)).alias("venue_address"),
        _string(_at(address, "postalCode")).alias("venue_zip"), _string(_at(address, "addressLocality")).alias("venue_city"), _number(_at(geo, "latitude")).alias("lat"), _number(_at(geo, "longitude")).alias("lng"),
        F.array_min("_prices").alias("price_min"), F.array_max("_prices").alias("price_max"), online.alias("is_online"), F.coalesce(F.contains(_string(_at(e, "eventStatus")), F.lit("Cancelled")), F.lit(False)).alias("is_cancelled"),
        F.array_compact(F.transform(_many(_at(e, "performer")), _named)).alias("artists"), F.get(F.array_compact(F.transform(_kinds(e), lambda k: F.try_element_at(categories, k))), F.lit(0)).alias("category_slug"),
    )
