"""What a French search asks for: words as filters, and whole requests as intents, as Columns over any number of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .titles import let

# Words of a search box that mean a filter, over folded text; those of a category count in short searches only.
TOPIC_WORDS = (("humour", r"\b(stand[\s-]?up|standup|humour|humoriste|one[\s-]?man[\s-]?show|comedy club)\b"),)
INTENT_WORDS = (("en-famille", r"\b(en famille|enfants?|kids|jeune public)\b"),)
FREE_WORDS = r"\b(gratuite?s?|gratos|entree libre)\b"
CATEGORY_WORDS = (
    ("expos", r"\b(expos?|expositions?)\b"), ("concerts", r"\b(concerts?)\b"), ("theatre", r"\b(theatres?|pieces? de theatre)\b"), ("cinema", r"\b(cine|cinemas?|films?)\b"), ("spectacles", r"\b(spectacles?)\b"), ("danse", r"\b(danse)\b"),
)
GENRES = r"\b(metal|metalcore|hard ?rock|hardcore|punk|rock|jazz|blues|rap|hip ?hop|techno|electro|house|reggae|ska|soul|funk|folk|r ?& ?b|rnb|disco|salsa|afrobeats?|grunge|emo|shoegaze|indie)\b"
GENRE_CATEGORIES = ("concerts", "festivals", "soirees")
FILLERS = r"^(?:(?:a|au|aux|de|des|du|en|et|la|le|les|l|d|un|une|pour|avec|ce|soir|paris)\s*)*$"
SHORT = 3
# Words of a request, over folded text; of the first group only the first that fits counts.
WHEN = (
    ("now", r"\b(maintenant|tout de suite|la maintenant|dans l'heure)\b"), ("tonight", r"\b(ce soir|cette nuit|ce soir-la|tonight)\b"), ("today", r"\b(aujourd'hui|aujourdhui|cet aprem|cet apres-midi|ce midi)\b"), ("tomorrow", r"\b(demain)\b"),
    ("weekend", r"\b(ce week-?end|ce we|samedi|dimanche|vendredi soir)\b"), ("week", r"\b(cette semaine|dans la semaine|les prochains jours)\b"), ("month", r"\b(ce mois|ce mois-ci)\b"),
)
WHEN_LABELS = {"now": "maintenant", "tonight": "ce soir", "today": "aujourd'hui", "tomorrow": "demain", "weekend": "ce week-end", "week": "cette semaine", "month": "ce mois-ci"}
ASKED_CATEGORIES = (
    ("concerts", r"\b(concerts?|musique|live|jazz|rock|rap|electro|classique|opera|chanson|dj|groupe)\b"), ("expos", r"\b(expos?|expositions?|musees?|galeries?|peinture|photo(graphie)?s?|art contemporain|vernissage)\b"),
    ("theatre", r"\b(theatre|piece|comedie)\b"), ("spectacles", r"\b(spectacles?|humour|humoriste|stand[ -]?up|one man|cirque|magie|cabaret|comedie musicale|impro)\b"), ("danse", r"\b(danse|ballet|choregraph\w*)\b"),
    ("cinema", r"\b(cine|cinema|films?|projections?|seances?|avant-premiere)\b"), ("festivals", r"\b(festivals?)\b"), ("conferences", r"\b(conferences?|rencontres?|debats?|lectures?|talks?)\b"),
    ("ateliers", r"\b(ateliers?|workshops?|cours|initiation)\b"), ("visites", r"\b(visites?|balades?|promenades?|patrimoine)\b"),
)
MUSICAL = "comedie musicale"  # is no theatre
MOODS = (
    ("en-amoureux", r"\b(amoureux|en couple|a deux|romanti\w*|date|rencard|ma copine|mon copain|ma femme|mon mari)\b"), ("entre-amis", r"\b(entre amis|avec des amis|avec mes potes|entre potes|en bande|a plusieurs|groupe d'amis)\b"),
    ("en-famille", r"\b(en famille|enfants?|kids|gamins?|bebes?|petits?|famille|ado)\b"), ("insolite", r"\b(insolite|original|originale|atypique|decale|surprenant|inhabituel|secret|bizarre)\b"),
    ("plein-air", r"\b(plein air|exterieur|dehors|en terrasse|jardins?|parcs?)\b"), ("festif", r"\b(faire la fete|danser|soiree|clubbing|fete|boite)\b"), ("chill", r"\b(calme|tranquille|chill|cosy|reposant|detente)\b"),
    ("culture-pointue", r"\b(intello|pointu|curieux|apprendre|reflechir)\b"),
)
ASKED_FREE = r"\b(gratuit\w*|gratos|sans payer|free|entree libre|pas cher du tout)\b"
AT_MOST = r"(?:moins de|max(?:imum)?|pas plus de|jusqu'a|budget(?: de)?|<)\s*(\d{1,3})\s*(?:€|euros?|e\b)"
CHEAP, CHEAP_EUROS = r"\b(pas cher|petit budget|bon marche|abordable)\b", 15
PEOPLE = r"\b(\d|deux|trois|quatre|cinq|six)\s+(?:personnes|amis|potes|places)\b"
NUMBERS = {"deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6}
COUPLE = r"\b(a deux|en couple|tous les deux)\b"
NEAR = r"\b(pres de moi|autour de moi|a cote|pas loin|proche|dans le coin|quartier)\b"
ASKED_GENRES = r"\b(jazz|rock|rap|electro|classique|opera|blues|soul|funk|reggae|metal|techno|house|salsa|tango|photo|street art|impressionnis\w*|manga|bd|cirque|magie|impro|stand[ -]?up|piano|orgue)\b"
MOST_KEYWORDS = 4
PLACE = r"(?:(?:dans le|le|du) )?\b(?:750\d{2}|\d{1,2})\s?(?:er|eme|e)?\b\s?(?:€|euros?\b|ans\b|h\b|heures?\b|personnes?\b|min)?"
UNIT = r"(?:€|euros?|ans|h|heures?|personnes?|min)$"
PLACE_MARK = r"^(?:dans le|le|du) |750\d{2}|\d\s?(?:er|eme|e)$"


def padded(raw: Column) -> Column:
    return F.concat(F.lit(" "), text.fold(F.replace(F.coalesce(raw, F.lit("")), F.lit("’"), F.lit("'"))), F.lit(" "))


def _hits(t: Column, rules) -> Column:
    return F.array_compact(F.array(*(F.when(t.rlike(p), slug) for slug, p in rules)))


def search_filters(raw: Column) -> Column:
    """struct(q, categories, intents, topics, free): words better understood as filters than as text, and the text that is left."""

    def read(t: Column) -> Column:
        short = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= SHORT
        named = F.when(short, _hits(t, CATEGORY_WORDS)).otherwise(F.array().cast("array<string>"))
        genre = short & t.rlike(GENRES) & (F.size(named) == 0)
        categories = F.when(genre, F.array(*map(F.lit, GENRE_CATEGORIES))).otherwise(named)
        gone = reduce(lambda x, p: F.regexp_replace(x, p, " "), (*(p for _, p in TOPIC_WORDS), *(p for _, p in INTENT_WORDS), FREE_WORDS), t)
        gone = F.when(short, reduce(lambda x, p: F.regexp_replace(x, p, " "), (p for _, p in CATEGORY_WORDS), gone)).otherwise(gone)
        rest = F.trim(F.regexp_replace(gone, r"\s+", " "))
        free, topics, intents = t.rlike(FREE_WORDS), _hits(t, TOPIC_WORDS), _hits(t, INTENT_WORDS)
        any_ = free | (F.size(topics) + F.size(intents) + F.size(categories) > 0)
        q = F.when(~any_, F.nullif(F.trim(raw), F.lit(""))).when(~rest.rlike(FILLERS), rest)
        return F.struct(q.alias("q"), categories.alias("categories"), intents.alias("intents"), topics.alias("topics"), free.alias("free"))

    return let(F.replace(padded(raw), F.lit("'"), F.lit(" ")), read)


def _places(t: Column) -> Column:
    found = F.transform(F.regexp_extract_all(t, F.lit(PLACE), 0), F.trim)
    marked = F.filter(found, lambda x: x.rlike(PLACE_MARK) & ~x.rlike(UNIT))
    return F.array_distinct(F.array_compact(F.transform(marked, lambda x: text.arrondissement(F.regexp_extract(x, r"(750\d{2}|\d{1,2})", 1)))))


def request(raw: Column) -> Column:
    """struct(when, categories, arrondissements, max_price, free, intents, keywords, near_me, people, summary) of a request."""

    def read(t: Column) -> Column:
        when = reduce(lambda x, r: x.when(t.rlike(r[1]), r[0]), WHEN[1:], F.when(t.rlike(WHEN[0][1]), WHEN[0][0]))
        plain = F.replace(t, F.lit(MUSICAL), F.lit(" "))
        categories = F.array_compact(F.array(*(F.when((plain if slug == "theatre" else t).rlike(p), slug) for slug, p in ASKED_CATEGORIES)))
        budget = F.nullif(F.regexp_extract(t, AT_MOST, 1), F.lit(""))
        price = F.when(budget.isNotNull(), budget.cast("int")).when(t.rlike(CHEAP), CHEAP_EUROS)
        word = F.nullif(F.regexp_extract(t, PEOPLE, 1), F.lit(""))
        numbers = F.create_map(*(F.lit(x) for kv in NUMBERS.items() for x in kv))
        people = F.when(word.isNotNull(), F.coalesce(F.try_element_at(numbers, word), F.try_to_number(word, F.lit("9")).cast("int"))).when(t.rlike(COUPLE), 2)
        keywords = F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(ASKED_GENRES), 1)), 1, MOST_KEYWORDS)
        return F.struct(
            when.alias("when"), categories.alias("categories"), _places(t).alias("arrondissements"), price.alias("max_price"), t.rlike(ASKED_FREE).alias("free"), _hits(t, MOODS).alias("intents"),
            keywords.alias("keywords"), t.rlike(NEAR).alias("near_me"), people.alias("people"),
        )

    return let(let(padded(raw), read), lambda i: i.withField("summary", summary(i)))


def summary(i: Column) -> Column:
    """One short French sentence that says a request again."""
    labels = F.create_map(*(F.lit(x) for kv in WHEN_LABELS.items() for x in kv))
    what = F.when(F.size(i["keywords"]) > 0, F.array_join(i["keywords"], ", ")).when(F.size(i["categories"]) > 0, F.array_join(i["categories"], " ou ")).otherwise("une sortie")
    where = F.when(F.size(i["arrondissements"]) > 0, F.concat(F.lit("dans le "), F.array_join(i["arrondissements"], ", ")))
    cost = F.when(i["free"], "gratuite").when(i["max_price"].isNotNull(), F.concat(F.lit("à moins de "), i["max_price"].cast("string"), F.lit(" €")))
    return F.concat_ws(" ", what, F.try_element_at(labels, i["when"]), where, F.when(i["near_me"], "près de toi"), cost)


def well_understood(raw: Column, i: Column) -> Column:
    """Whether the rules made enough of a request: one thing in a short one, three in a longer one."""
    signs = (i["when"].isNotNull(), (F.size(i["categories"]) + F.size(i["keywords"])) > 0, (F.size(i["arrondissements"]) > 0) | i["near_me"], i["free"] | i["max_price"].isNotNull(), F.size(i["intents"]) > 0)
    n = reduce(Column.__add__, (F.when(x, 1).otherwise(0) for x in signs))
    return n >= F.when(F.size(F.split(F.trim(raw), r"\s+")) <= 4, 1).otherwise(3)
