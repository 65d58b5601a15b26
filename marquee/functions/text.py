"""Text functions as Columns, and their plain Python twins where the driver needs them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accent table of the fold.
ACCENTS_FROM = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
ACCENTS_TO = "aaaaaaceeeeiiiinooooouuuuyy"

# Greek and Cyrillic letters in Latin ones, letter by letter, and those that take several.
LETTERS = {"αβγδεζηικλμνξοπρσςτυωάέήίόύώϊϋ": "abgdezeiklmnxoprsstuoaeeiouoiu", "абвгдеёзийклмнопрстуфыэіїє": "abvgdeeziiklmnoprstufyeiie"}
LETTERS_OF_SEVERAL = {"θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ъ": " ", "ь": " "}

# Words that a search ignores.
STOP_WORDS = (
    "a au aux avec ce ces dans de des du en et je la le les mon ma mes ou par pas pour quelque chose sur un une veux voudrais cherche ce soir paris sortir sortie truc"
).split()

# Words that a search matches as whole words.
WHOLE_WORDS = "metal metalcore rock punk hardcore jazz blues rap techno electro house reggae ska soul funk folk rnb disco salsa grunge emo indie".split()

# Words that names and titles are compared without.
ARTICLES = "le la les l the du de des d et a au aux".split()
VENUE_NOISE = "paris france salle".split()
TITLE_NOISE = (
    "concert spectacle exposition expo complet live en guest guests invites invite presente presentent paris tournee tour nouveau nouvelle date dates supplementaire derniere dernieres"
).split()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A select whose columns are computed once a row: what follows, filters too, is not put before a generator."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def fold(c: Column) -> Column:
    """Lower case without the accents of the table (other letters stay)."""
    return F.translate(F.lower(c), ACCENTS_FROM, ACCENTS_TO)


def fold_ligatures(c: Column) -> Column:
    """fold(), and the two ligatures spelled out."""
    return F.replace(F.replace(fold(c), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def fold_py(s: str) -> str:
    return s.lower().translate(str.maketrans(ACCENTS_FROM, ACCENTS_TO)).replace("œ", "oe").replace("æ", "ae")


def transliterated(c: Column) -> Column:
    """Lower-case Greek and Cyrillic letters in Latin ones; other scripts have no table and stay as they are (so they are no words to :func:`words_of`)."""
    foreign = c.rlike("[\u0370-\u04FF]")
    single = F.translate(c, "".join(LETTERS), "".join(LETTERS.values()))
    return F.when(foreign, reduce(lambda out, kv: F.replace(out, F.lit(kv[0]), F.lit(kv[1])), LETTERS_OF_SEVERAL.items(), single)).otherwise(c)


def words_of(c: Column) -> Column:
    """Folded text as words of letters and digits, one space apart; ``&`` reads as et, and Greek and Cyrillic as :func:`transliterated`."""
    spelled = let(F.replace(fold_ligatures(c), F.lit("&"), F.lit(" et ")), transliterated)
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """Key of a film or work: folded, anything else one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def search_tokens(q: str) -> list[str]:
    """At most six folded words of three letters or more that are no stop-words."""
    bare = re.sub(r"[^a-z0-9\s-]", " ", fold_py(q))
    return [t for t in bare.split() if len(t) >= 3 and t not in STOP_WORDS][:6]


def token_match(text: Column, token: str) -> Column:
    """A token in folded text: genre words whole, others anywhere."""
    return text.rlike(rf"\b{re.escape(token)}\b") if token in WHOLE_WORDS else text.contains(token)


def normal_name(c: Column) -> Column:
    """A venue's name without articles, noise and arrondissements; the folded name if nothing is left."""
    folded = words_of(c)
    bare = F.regexp_replace(folded, r"\b75[0-9]{3}\b|\b[0-9]{1,2}(e|er|eme)\b", " ")
    kept = F.array_join(F.filter(F.split(bare, " +"), lambda w: (w != "") & ~w.isin(*ARTICLES, *VENUE_NOISE)), " ")
    return F.when(kept != "", kept).otherwise(folded)


def plain_title(c: Column) -> Column:
    """A title for comparison across sources: no brackets, years, articles or noise words."""
    bare = F.regexp_replace(fold_ligatures(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(19|20)[0-9]{2}\b", " "), "[^a-z0-9]+", " "))
    kept = lambda b: F.array_join(F.filter(F.split(b, " +"), lambda w: (w != "") & ~w.isin(*ARTICLES, *TITLE_NOISE)), " ")
    return let(bare, lambda b: let(kept(b), lambda k: F.when(k != "", k).otherwise(b)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces before and one after."""
    padded = F.transform(F.filter(F.split(words_of(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; 0 if either has none. Takes the arrays of trigrams()."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / any_).otherwise(F.lit(0.0))


def truncated(c: Column, n: int) -> Column:
    """At most n characters, cut before the last broken word, with an ellipsis."""
    # \z, as $ also holds before a last line break; white space as SQL has it, without the vertical tab
    cut = F.regexp_replace(c.substr(1, n - 1), r"[\t\n\f\r ]+[^\t\n\f\r ]*\z", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits of the parts; a null part is an empty place."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 16)


def artist_key(c: Column) -> Column:
    """Folded words of 2 to 80 characters, else null."""
    k = words_of(c)
    return F.when(F.length(k).between(2, 80), k)


def has_artist(title_words: Column, key: Column) -> Column:
    """Whether the words of a title hold all words of a key, whole and in order."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.contains(pad(title_words), pad(key))


def arrondissement(zip_or_number: Column) -> Column:
    """'75011', '11', '11e', '11ème' -> '11e'; 75116 -> '16e'; null outside 1 to 20."""
    s = F.lower(F.trim(zip_or_number))
    digits = F.when(s == "75116", "16").otherwise(F.coalesce(F.nullif(F.regexp_extract(s, r"^750([0-9]{2})$", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"^([0-9]{1,2})\s*(er|e|eme|ème|è)?$", 1), F.lit(""))))
    n = digits.cast("int")
    return F.when(n == 1, "1er").when(n.between(2, 20), F.concat(n.cast("string"), F.lit("e")))


def zip_code(c: Column) -> Column:
    """First five-digit code in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[^0-9])([0-9]{5})(?:[^0-9]|$)", 1), F.lit(""))


def masked_email(c: Column) -> Column:
    """First letter, stars, and the domain."""
    return F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))


def first_name(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+").getItem(0)


def like_escaped(q: str) -> str:
    """q with the wildcards of LIKE escaped by a backslash."""
    return re.sub(r"([\\%_])", r"\\\1", q)
