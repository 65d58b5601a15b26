"""Names of venues as Columns: what tells one place from another, and whether two names may mean the same one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import let

# Words for a kind of place or a programme, which do not tell places apart.
GENERIC_WORDS = (
    "theatre theatres salle salles paris jazz club bar bars studio scene scenes nationale national restaurant cabaret live music musique concert concerts espace lieu the and et de du des la le les l d a au aux en france idf ile spectacle spectacles officiel official venue arena"
).split()
# Keys that many places share, which name one only together with a spot.
GENERIC_KEYS = (
    "mairie mediatheque bibliotheque eglise gymnase parc square jardin fetes centreculturel centre culturel auditorium conservatoire cinema maisonquartier maison galerie musee chapelle temple stade piscine kiosque place cour foyer atelier ateliers librairie grandesalle petitesalle salledesfetes hall jardins theatre salle"
).split()
# Words of streets, stations and gardens, which are often called after a building near by.
OPEN_PLACES = "place square parvis rue quai quais berges metro station gare jardin jardins parc pont esplanade avenue boulevard rampe port bassin canal".split()
# Fixed value: what stands between the name of a complex and that of a hall in it.
PART_MARKS = r"\s+[-–—|:/]\s+|\s*[|/]\s*|\s+[–—]\s*|\s*[–—]\s+|\("
AREA_CODE = r"^(75[0-9]{3}|9[234][0-9]{3}|[0-9]{1,2}(e|er|eme))$"
ALIKE = 0.5  # of the trigrams of two names
SHORT_KEY = 4


def _telling(words: Column) -> Column:
    """The words that are no generic ones, no post codes and no arrondissements, each once."""
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*GENERIC_WORDS) & ~w.rlike(AREA_CODE)))


def tokens(name: Column) -> Column:
    """The telling words of a name in order; those after the last ``à`` are a town, if two telling words come before it."""
    def of(folded: Column) -> Column:
        before = _telling(F.split(F.regexp_extract(folded, "^(.*) a .*$", 1), " "))
        return let(before, lambda head: F.when(F.size(head) >= 2, head).otherwise(_telling(F.split(folded, " "))))

    return let(text.words_of(F.coalesce(name, F.lit(""))), of)


def key(tokens_: Column) -> Column:
    """The telling words in alphabetical order, without spaces."""
    return F.array_join(F.array_sort(tokens_), "")


def signature(name: Column) -> Column:
    """All that :func:`compatible` needs of a name, computed once: tokens, key, plain name, digits, trigrams, the tokens of the complex and of each hall."""
    name = F.coalesce(name, F.lit(""))
    parts = F.filter(F.split(name, PART_MARKS), lambda p: F.btrim(p, F.lit(" )")) != "")

    def of(own: Column) -> Column:
        return F.struct(own.alias("tokens"), key(own).alias("key"), F.filter(own, lambda w: w.rlike("^[0-9]+$")).alias("digits"), F.exists(own, lambda w: w.isin(*OPEN_PLACES)).alias("open"), text.trigrams(F.array_join(own, " ")).alias("grams"))

    def by_part(each: Column) -> Column:
        return F.struct(F.coalesce(F.get(each, F.lit(0)), F.array().cast("array<string>")).alias("complex"), F.filter(F.slice(each, 2, 1000), lambda t: F.size(t) > 0).alias("halls"))

    def whole(x: Column) -> Column:
        return F.struct(*(x["own"][f].alias(f) for f in ("tokens", "key", "digits", "open", "grams")), x["plain"].alias("plain"), *(x["parts"][f].alias(f) for f in ("complex", "halls")))

    return let(F.struct(let(tokens(name), of).alias("own"), text.normal_name(name).alias("plain"), let(F.transform(parts, tokens), by_part).alias("parts")), whole)


def _inside(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _other_hall(a: Column, b: Column) -> Column:
    """a is a hall of a complex that b names too, and b does not name the hall."""
    return F.arrays_overlap(a["complex"], b["tokens"]) & F.exists(a["halls"], lambda hall: ~_inside(hall, b["tokens"]))


def compatible(a: Column, b: Column) -> Column:
    """Whether two names (signatures) may mean one place, given that they are at one spot.

    Equal keys always do. Else neither may be generic, only one an open place, of other numbers, or another hall of a complex;
    and the words of one must be among the other's, one's key be in the other's, or half of their trigrams agree.
    """
    never = (a["open"] != b["open"]) | ((F.size(a["digits"]) > 0) & (F.size(b["digits"]) > 0) & (F.array_sort(a["digits"]) != F.array_sort(b["digits"])))
    never = never | a["key"].isin(*GENERIC_KEYS) | b["key"].isin(*GENERIC_KEYS) | _other_hall(a, b) | _other_hall(b, a)
    contained = ((F.length(a["key"]) >= SHORT_KEY) & b["key"].contains(a["key"])) | ((F.length(b["key"]) >= SHORT_KEY) & a["key"].contains(b["key"]))
    alike = _inside(a["tokens"], b["tokens"]) | _inside(b["tokens"], a["tokens"]) | contained | (text.similarity(a["grams"], b["grams"]) >= ALIKE)
    return (a["key"] != "") & (b["key"] != "") & ((a["key"] == b["key"]) | (~never & alike))


def same_name(a: Column, b: Column) -> Column:
    """Equal keys, or equal plain names of three letters or more."""
    return ((a["key"] != "") & (a["key"] == b["key"])) | ((a["plain"] == b["plain"]) & (F.length(a["plain"]) >= 3))
