"""Who plays: names from a source's line-up, else from the title of a musical outing, as Columns.

A title is bared of what stands around names (brackets, hashtags, where and how it
takes place), the part that holds the line-up is chosen (before or after a colon
or a dash), it is cut into names, and what is a programme, a genre, a composer or
a phrase rather than a name is left out by its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import let

# Categories whose titles name artists, and limits of a name.
MUSICAL = ("concerts", "festivals", "soirees")
MOST_CHARS, MOST_WORDS, MOST_SOURCE_CHARS = 60, 6, 120
# Keys that sources give for nobody, and keys that are no name alone.
NOBODY = (
    "no information|n a|na|tba|tbc|tbd|guest|guests|special guest|special guests|invite|invites|invite surprise|various artists|artistes divers|divers artistes|artiste|artistes|line up|lineup|undefined|unknown|inconnu"
).split("|")
NO_NAME = "paris|ile de france|france|live|dj|guest|guests|mc|trio|duo|quartet|quintet|ensemble|orchestre|choeur|big band|and more|more|djs|mcs|jr|sr".split("|")
# Words of programmes, series and halls.
PROGRAMME = (
    "concert|concerts|soiree|soirees|jam|jams|session|sessions|open mic|scene ouverte|festival|festivals|musee|party|night|nights|nuit|nuits|hommage|tribute|show|experience|karaoke|bingo|blind test|clubbing|edition|celebration|spectacle|cine concert|masterclass|atelier|ateliers|conference|visite|recital|"
    "symphonie|symphonies|symphonique|requiem|messe|concerto|stabat|saisons|noel|christmas|halloween|nouvel an|programme|guest|guests|friends|invites|candlelight|gala|bal|boum|fete|apero|brunch|release|album|tour|tournee|anniversaire|birthday|best of|classiques|hits|lundis|mardis|mercredis|jeudis|vendredis|"
    "samedis|dimanches|musicaux|musicales|jazz club|club|salon|dj set|live|more|complet|programmation|cabaret|drag|quiz|brocante|orchestre de|orchestre national|philharmonie|olympia|bataclan|zenith|cigale|maroquinerie|arena|cathedrale|eglise|chapelle|basilique|plein air|dansant|dansante|danse|carnaval|"
    "marathon|matinee|apres midi|after|warm up|closing|opening|residency|residence|takeover|showcase|battle|contest|tremplin|audition|concours|chorale|choral|heritage|special|carte blanche|legende|legendes|story|raconte|sonate|sonates|kiosque|evaluation|chante|joue|interprete|autour de"
)
# Genres, which a description begins with; composers, who do not play; words that begin a phrase.
GENRES = (
    "metal|rock|jazz|pop|electro|electronique|techno|house|disco|classique|baroque|gospel|blues|rap|hip|reggae|funk|soul|k pop|kpop|salsa|tango|musique|musiques|chanson|chansons|punk|folk|world|afro|latino|latin|dub|drum|trance|hardcore|indie|lyrique|opera|operette|piano|orgue|violon|guitare|chant|chants|"
    "chorale|swing|manouche|flamenco|fado|rnb|r b|variete|zouk|kizomba|bachata|dancehall|amapiano|groove"
).split("|")
COMPOSERS = (
    "bach|js bach|j s bach|beethoven|mozart|vivaldi|verdi|liszt|chopin|debussy|ravel|haendel|handel|schubert|schumann|brahms|tchaikovski|tchaikovsky|mahler|dvorak|korngold|bizet|puccini|rossini|wagner|haydn|mendelssohn|rachmaninov|rachmaninoff|satie|faure|saint saens|berlioz|stravinsky|prokofiev|"
    "chostakovitch|shostakovich|strauss|offenbach|gershwin|piazzolla|astor piazzolla|albinoni|pergolese|monteverdi|purcell|telemann|rameau|lully|couperin|scarlatti|paganini|grieg|sibelius|elgar|bartok|poulenc|gounod|massenet|bruckner|franck|borodine|moussorgski|smetana|janacek|messiaen|part|glass|"
    "philip glass|ennio morricone|morricone|hans zimmer|john williams"
).split("|")
PHRASE = "dans|du|des|en|pour|sur|a|au|aux|entre|autour|sous|vers|quand|avec|chez|une|un|the best|le meilleur|la grande|le grand|spectacle|soiree|concert|visite|vivez|venez|decouvrez".split("|")
# What stands between names, between parts, around names, and after and before one.
BETWEEN = r"(?iu)\s+\+\s+|\s*\+\s*(?-i:(?=[A-ZÀ-Þ0-9]))|\s+x\s+|\s+&\s+|\s*,\s+|\s+/\s+|\s+feat\.?\s+|\s+ft\.?\s+|\s+featuring\s+|\s+invitent?\s+|\s+avec\s+|\s+with\s+|\s+w/\s*|\s+b2b\s+|\s+vs\.?\s+"
BETWEEN_TWO = r"\s+(?i:et|and)\s+(?=[A-ZÀ-Þ])"
DASH = r"\s+[–—―‐|⎜•·]\s+|\s+-\s+"
IN_CONCERT = r"(?iu)[\s,]*\b(?:en|in)\s+(?:concert|live|showcase|tourn[ée]e|dj set)\b[^+]*"
HASHTAG = r"(?:^|\s)#[^\s#]*(?:\s+[A-Za-zÀ-ÿ0-9][^\s#]*)*"
GUESTS = r"(?iu)\s*\+?\s*(?:special\s+)?guests?\s*:\s*"
INSTRUMENT = r"(?iu)[\s,]+(?:piano|violon|violoncelle|alto|orgue|guitare|clavecin|harpe|fl[uû]te|saxophone|trompette|contre-t[ée]nor|soprano|mezzo(?:-soprano)?|baryton|t[ée]nor|chant|voix)$"
AFTER = (
    r"(?iu)(?:\s*[-,:]?\s*\b(?:\+\s*)?(?:special guests?|guests?|invit[ée]s?(?: surprise)?|and more|& more|and friends|& friends|dj set|live set|live|release party|album release|sortie d['’]album|complet|sold out|annul[ée]|report[ée]|nouvelle date|date suppl[ée]mentaire|"
    r"le \d{1,2}(?:er)? [a-zéû]+(?: \d{4})?|\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?|20\d\d|!+))+\s*$"
)
BEFORE = r"(?iu)^(?:concert\s*(?:de|du|des|d['’])\s*|sortie d['’]album\s*(?:de|du|d['’])?\s*|release party\s*(?:de|du|d['’])?\s*|showcase\s*(?:de|du|d['’])?\s*|r[ée]cital\s*(?:de|du|d['’])\s*)"
AT_PLACE = (r"\s+@\s*.*$", r"\s+(?i:à|au|aux)\s+(?i:la\s+|le\s+|les\s+|l['’]\s*)?(?=[A-ZÀ-Þ0-9]).*$")
DESCRIBED = r"(?iu)#|\[\d|\b\d+\b|curator|presents?|pr[ée]sente"
EDGE = " -–—:,;!?¡¿\"'«»“”"

_cut = lambda c, *patterns: reduce(lambda out, p: F.regexp_replace(out, p, ""), patterns, c)
_squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
_names = lambda c: F.filter(F.split(c, BETWEEN), lambda x: F.trim(x) != "")


def key(name: Column) -> Column:
    """Null where there is no name: see :func:`text.artist_key`."""
    return text.artist_key(F.coalesce(name, F.lit("")))


def _trimmed(name: Column) -> Column:
    """A name without what is said before and after it."""
    once = lambda c: _cut(F.btrim(_cut(c, r"\s*\([^()]*\)\s*$", AFTER), F.lit(EDGE)), INSTRUMENT, BEFORE)
    start = _cut(F.btrim(F.regexp_replace(name, r"\.{2,}|…", " "), F.lit(EDGE)), AT_PLACE[0], IN_CONCERT)
    return F.btrim(_squeezed(_cut(let(let(let(start, once), once), once), AT_PLACE[1])), F.lit(EDGE))


def _begins_with(k: Column, words: list[str]) -> Column:
    """The first word, or the first two, of a key."""
    return F.substring_index(k, " ", 1).isin(*words) | F.substring_index(k, " ", 2).isin(*words)


def _programme(k: Column) -> Column:
    return k.rlike(rf"\b(?:{PROGRAMME})\b")


def _described(part: Column) -> Column:
    """Whether a part of a title tells of a programme and not of who plays."""
    of = lambda k: k.isNull() | _programme(k) | F.substring_index(k, " ", 1).isin(*GENRES)
    return let(key(_trimmed(part)), of) | part.rlike(DESCRIBED)


def _is_name(name: Column, venue: Column, cased: Column) -> Column:
    def of(k: Column) -> Column:
        n_words = F.size(F.split(k, " "))
        other = k.isin(*NO_NAME, *NOBODY, *COMPOSERS) | F.coalesce(k == venue, F.lit(False)) | _programme(k) | _begins_with(k, GENRES) | _begins_with(k, PHRASE) | (k.rlike(r"\b(?:19|20)\d\d\b") & (n_words > 1))
        return k.isNotNull() & (n_words <= MOST_WORDS) & (F.length(F.replace(k, F.lit(" "), F.lit(""))) >= 2) & ~other

    brackets = F.length(F.regexp_replace(name, r"[^(]", "")) == F.length(F.regexp_replace(name, r"[^)]", ""))
    return F.coalesce(let(key(name), of), F.lit(False)) & (F.length(name) <= MOST_CHARS) & ~(cased & name.rlike(r"^\p{Ll}")) & name.rlike("[A-Za-zÀ-ÿ]") & brackets


def of_title(title: Column, venue: Column) -> Column:
    """The names in a title, in order; ``venue`` is the venue's key."""

    def bared(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, r"\[[^\]]*\]", " "), r"\s*\([^()]*\)\s*$", "")
        t = F.regexp_replace(t, r"(?i),?\s+(jr|sr)\.?(?=$|\s|,)", " $1.")  # a part of the name
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, GUESTS, " + "), HASHTAG, " "), IN_CONCERT, "")
        return F.btrim(_squeezed(t), F.lit(" -–—:,;"))

    def by_colon(t: Column) -> Column:
        left, right = F.regexp_extract(t, r"^(.*?)\s*:\s+.*$", 1), F.regexp_extract(t, r"^.*?\s*:\s+(.*)$", 1)
        return F.when(~t.rlike(r":\s"), t).when(left.rlike(INSTRUMENT), left).when(_described(left) | (F.size(_names(right)) >= 2), right).otherwise(left)

    def by_dash(t: Column) -> Column:
        def of(parts: Column) -> Column:
            a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
            return F.when(F.size(parts) < 2, t).when((F.size(_names(a)) < 2) & _described(a) & ~_described(b), b).otherwise(a)

        return let(F.filter(F.split(t, DASH), lambda x: F.trim(x) != ""), of)

    def pair(piece: Column) -> Column:
        """Two full names joined by ``et`` are two; one duo's name is one."""
        return let(F.split(piece, BETWEEN_TWO), lambda xs: F.when((F.size(xs) > 1) & F.forall(xs, lambda x: F.size(F.split(F.trim(x), r"\s+")) >= 2), xs).otherwise(F.array(piece)))

    raw = _squeezed(F.coalesce(title, F.lit("")))
    pieces = let(let(let(raw, bared), by_colon), lambda t: F.flatten(F.transform(F.split(by_dash(t), BETWEEN), pair)))
    cased = raw.rlike(r"\p{Lu}")
    return F.filter(F.transform(pieces, _trimmed), lambda n: (n != "") & _is_name(n, venue, cased))


def of_outing(title: Column, category: Column, given: Column, venue_name: Column) -> Column:
    """array<struct<name, key, origin>>, each key once: the source's names, where any of them is one, else those of the title of a musical outing.

    given: array of names, or null. The venue's own name is no artist.
    """
    venue = key(venue_name)

    def made(names: Column, origin: str) -> Column:
        rows = F.transform(names, lambda n: let(F.substring(_squeezed(n), 1, MOST_SOURCE_CHARS), lambda x: F.struct(x.alias("name"), key(x).alias("key"), F.lit(origin).alias("origin"))))
        kept = F.filter(rows, lambda r: r["key"].isNotNull() & ~r["key"].isin(*NOBODY) & ~F.coalesce(r["key"] == venue, F.lit(False)))
        return let(kept, lambda xs: F.filter(xs, lambda x, i: F.array_position(xs["key"], x["key"]) == i + 1))

    source = made(F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda n: n.isNotNull() & (F.length(F.trim(n)) <= MOST_SOURCE_CHARS)), "source")
    titled = F.when(category.isin(*MUSICAL), made(of_title(title, venue), "title")).otherwise(F.filter(source, lambda _: F.lit(False)))
    return let(source, lambda s: F.when(F.size(s) > 0, s).otherwise(titled))
