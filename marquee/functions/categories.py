"""Categories of events from keywords, which are a parameter: {category: [keywords]}."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, first_match, text

#: Order in which ties go, context words, thresholds.
PRIORITY = ["Festivals", "Comedy Shows", "Art Shows", "Sports/Games", "Nightclubs", "Music", "Food Events", "Bars"]
CONTEXT = {
    "wine": {"Food Events": ["appetizers", "tasting", "pairing", "cheese", "food", "dining", "reception"], "Bars": ["bar", "pub", "cocktail", "drink", "happy hour", "bottle service"]},
    "art": {"Art Shows": ["gallery", "exhibition", "artist", "painting", "sculpture", "museum"], "Music": ["performance", "quartet", "band", "live", "show"]},
}
SECOND_LEAST, SECOND_SHARE = 2, 0.4


def match_counts(x: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Array of struct(n, rank, category) of the categories with a keyword in the text, the strongest first. Keywords match inside words."""
    lower = F.lower(text(x))
    rows = []
    for category, words in keywords.items():
        n = F.size(F.filter(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(lower, w)))
        boost = [F.when(F.contains(lower, F.lit(k)) & contains_any(lower, rules[category]), 1).otherwise(0) for k, rules in CONTEXT.items() if category in rules]
        n = F.when(n > 0, sum(boost, n)).otherwise(0)
        rows.append(F.struct((-n).alias("minus"), F.lit(PRIORITY.index(category) if category in PRIORITY else len(PRIORITY)).alias("rank"), F.lit(category).alias("category")))
    return F.array_sort(F.filter(F.array(*rows), lambda r: r["minus"] < 0))


def categories(x: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """The strongest category, and the second if it has 2 keywords and 0.4 of the first's."""
    found = match_counts(x, keywords)
    first, second = F.get(found, 0), F.get(found, 1)
    both = (-second["minus"] >= SECOND_LEAST) & (-second["minus"] >= -first["minus"] * SECOND_SHARE)
    names = F.transform(found, lambda r: r["category"])
    return F.slice(names, 1, F.when(F.coalesce(both, F.lit(False)), 2).otherwise(1))


def fallback(title: Column, venue: Column) -> Column:
    """Category by the words of title and venue, Music by default."""
    x = F.lower(F.concat(text(title), F.lit(" "), text(venue)))
    rules = [
        (contains_any(x, ["bar", "pub", "tavern"]), "Bars"),
        (F.contains(x, F.lit("club")) & ~F.contains(x, F.lit("comedy")), "Nightclubs"),
        (contains_any(x, ["restaurant", "cafe", "food"]), "Food Events"),
        (contains_any(x, ["theater", "theatre", "hall"]), "Music"),
        (contains_any(x, ["gallery", "museum"]), "Art Shows"),
    ]
    return first_match([(c, F.lit(v)) for c, v in rules], F.lit("Music"))


def smart_categories(title: Column, description: Column, venue: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    found = categories(F.concat_ws(" ", title, description, venue), keywords)
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback(title, venue)))


#: Colours of categories, and the default.
COLORS = {"Music": "#FF717A", "Festivals": "#6BC1FF", "Food Events": "#a8dca4", "Sports/Games": "#FF8352", "Comedy Shows": "#e6c580", "Art Shows": "#d87cfc", "Bars": "#FFBA0E", "Nightclubs": "#5963D1"}
DEFAULT_COLOR = "#03A4F1"
#: Words that put festivals and nightclubs before music.
FESTIVAL_WORDS, CLUB_WORDS = ["festival", "fest", "multi-day", "weekend event", "outdoor event"], ["nightlife", "club", "dance floor", "party", "beats"]
#: Another set of categories, with their words.
BROAD = {
    "Music": ["concert", "music", "band", "singer", "dj", "festival", "acoustic", "jazz", "rock", "pop"], "Comedy": ["comedy", "comedian", "standup", "improv", "funny", "humor"],
    "Arts & Theater": ["theater", "theatre", "play", "art", "gallery", "exhibition", "dance", "ballet", "opera"], "Nightlife": ["party", "club", "bar", "nightlife", "drinks", "dancing"],
    "Food & Drink": ["food", "restaurant", "wine", "beer", "tasting", "cooking", "chef", "dining"], "Sports": ["sport", "game", "match", "tournament", "race", "competition", "team"],
    "Education": ["workshop", "seminar", "class", "course", "lecture", "training", "learn"], "Family": ["family", "kids", "children", "child", "parent", "baby"],
    "Community": ["community", "volunteer", "charity", "fundraiser", "neighborhood", "local"], "Business": ["business", "networking", "conference", "meeting", "professional", "corporate"],
}


def color(category: Column) -> Column:
    return first_match([(category == k, F.lit(v)) for k, v in COLORS.items()], F.lit(DEFAULT_COLOR))


def reordered(x: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Names of ``match_counts`` in order, with Festivals before Music where its own words match, and Nightclubs before Music where its own do and the counts differ by 2 at most: the two change places."""
    found, lower = match_counts(x, keywords), F.lower(text(x))

    def own(category: str, words: Sequence[str]) -> Column:
        mine = [k for k in keywords.get(category, []) if any(w in k.lower() for w in words)]
        return contains_any(lower, [k.lower() for k in mine]) if mine else F.lit(False)

    count = lambda c: -F.get(F.filter(found, lambda r: r["category"] == c), 0)["minus"]

    def swapped(names: Column, a: str, b: str, when: Column) -> Column:
        """b comes to a's place and a to b's, where b stands after a."""
        at = lambda c: F.array_position(names, c)
        go = (at(a) > 0) & (at(b) > at(a)) & when
        return F.when(F.coalesce(go, F.lit(False)), F.transform(names, lambda n: F.when(n == a, b).when(n == b, a).otherwise(n))).otherwise(names)

    names = swapped(F.transform(found, lambda r: r["category"]), "Music", "Festivals", own("Festivals", FESTIVAL_WORDS))
    return swapped(names, "Music", "Nightclubs", own("Nightclubs", CLUB_WORDS) & (F.abs(count("Music") - count("Nightclubs")) <= 2))


def broad_categories(x: Column, most: int = 2) -> Column:
    """The categories of ``BROAD`` with the most whole words in the text, ties in its order; Community without any."""
    lower = F.lower(text(x))
    # A word may be the end of one match and the start of the next, so what stands around it is only looked at.
    n = lambda words: F.size(F.regexp_extract_all(lower, F.lit(rf"(?<![a-z0-9_])(?:{'|'.join(words)})(?![a-z0-9_])"), 0))
    rows = F.array(*(F.struct((-n(words)).alias("minus"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, words) in enumerate(BROAD.items())))
    names = F.transform(F.slice(F.array_sort(F.filter(rows, lambda r: r["minus"] < 0)), 1, most), lambda r: r["c"])
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("Community")))


def valid_broad(c: Column, most: int = 3) -> Column:
    return F.slice(F.filter(c, lambda x: x.isin(list(BROAD))), 1, most)
