"""Known venues: exact and partial lookup, near names, better addresses.

``looked_up`` joins any number of names to any number of venues. Where the list
of venues is a small dimension, ``known_array`` reads it to the driver with a
check of its size and makes a literal array of it, for lookups inside other
column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, first_match, or_else, text
from marquee.functions.text import similarity, venue_key

MOST_VENUES = 10_000
NEAR = 0.8
#: Words that tell a street address.
STREET_WORDS = r"(?i)\b(street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|place|pl|court|ct|highway|hwy)\b"


def known_array(venues: DataFrame, most: int = MOST_VENUES) -> Column:
    """Literal array of struct(key, name, address) in order of ``ord``; raises for over ``most`` venues."""
    rows = venues.select("ord", "name", "address").orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} venues")
    s = [F.struct(venue_key(F.lit(r["name"])).alias("key"), F.lit(r["name"]).alias("name"), F.lit(r["address"]).alias("address")) for r in rows]
    return F.array(*s) if s else F.array().cast("array<struct<key:string,name:string,address:string>>")


def lookup(name: Column, city: Column, known: Column) -> Column:
    """Address of the known venue: of the name exactly, else the first whose name contains it or is contained in it and whose address has the city, if one is given."""
    q = venue_key(name)
    has_city = F.coalesce(city, F.lit("")) == ""
    exact = F.get(F.filter(known, lambda v: v["key"] == q), 0)["address"]
    near = F.get(F.filter(known, lambda v: (F.contains(v["key"], q) | F.contains(q, v["key"])) & (has_city | F.contains(F.lower(v["address"]), F.lower(text(city))))), 0)["address"]
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(exact, near))


GRAM = 3


def _grams(x: Column) -> Column:
    """All runs of one to GRAM characters."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - n + 1)), lambda i: F.substring(x, i, F.lit(n)))

    return F.array_distinct(F.concat(*(runs(n) for n in range(1, GRAM + 1))))


def _rarest(short: DataFrame, key: str, long: DataFrame, other: str) -> DataFrame:
    """``key`` and gram of each text of ``short`` whose runs of GRAM characters (itself if shorter) all stand in texts of ``long``: the run that the fewest of them have. Whatever contains the text has that run, so a word that all have decides nothing.

    ``short`` and ``long`` hold each text once. The counts are broadcast: there are no more of them than distinct runs of GRAM characters.
    """
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - GRAM + 1)), lambda i: F.substring(key, i, F.lit(GRAM)))
    own = short.select(key, F.explode(F.array_distinct(runs)).alias("gram"))
    seen = long.select(F.explode(_grams(F.col(other))).alias("gram"))
    count = seen.groupBy("gram").agg(F.count("*").alias("n"))
    met = own.join(F.broadcast(count), "gram", "left").groupBy(key)
    return met.agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).filter("all").drop("all")


def _containing(long: DataFrame, other: str, short: DataFrame, key: str) -> DataFrame:
    """``other`` and ``key`` of the texts of ``long`` that contain one of ``short``, each text once in its table. Runs that are no text's rarest are dropped where they are made."""
    rare = _rarest(short, key, long, other)
    runs = long.select(other, F.explode(_grams(F.col(other))).alias("gram")).join(F.broadcast(rare.select("gram").distinct()), "gram", "left_semi")
    return runs.join(rare, "gram").filter(F.contains(other, F.col(key))).select(other, key)


def looked_up(names: DataFrame, venues: DataFrame) -> DataFrame:
    """``names`` (id, name, city) with address: of the venue (ord, name, address) of that name, else the first whose name contains it or is contained in it and whose address has the city, if one is given.

    Of two texts of which one contains the other, the longer has every run of
    characters of the shorter, so both meet at the rarest of those, by an equi
    join. Each text is looked up once, however many rows have it. Keys without
    letters or digits meet nothing. Of repeated ids the rows count as one.
    """
    q = names.select("id", venue_key(F.col("name")).alias("q"), F.lower(text(F.col("city"))).alias("city")).filter("q <> ''")
    v = venues.select("ord", venue_key(F.col("name")).alias("key"), "address").filter("key <> ''")
    texts, keys = q.select("q").distinct(), v.select("key").distinct()
    pairs = _containing(texts, "q", keys, "key").unionByName(_containing(keys, "key", texts, "q"))
    met = q.select("q", "city").distinct().join(pairs.distinct(), "q").join(v, "key")
    has = (F.col("city") == "") | F.contains(F.lower("address"), F.col("city"))
    # A text is in its own key, so its exact venues are met too.
    same = F.min(F.when(F.col("q") == F.col("key"), F.struct("ord", "address")))["address"]
    answers = met.groupBy("q", "city").agg(same.alias("exact"), F.min(F.when(has, F.struct("ord", "address"))).alias("partial"))
    found = q.join(answers, ["q", "city"])
    found = found.groupBy("id").agg(F.min("exact").alias("exact"), F.min("partial")["address"].alias("partial"))
    return names.join(found, "id", "left").withColumn("address", F.coalesce("exact", "partial")).drop("exact", "partial")


def near_names(name: Column, known: Column) -> Column:
    """Known venues whose name is over NEAR like the name or contains it or is contained in it: array of struct(name, likeness)."""
    q = F.lower(text(name))
    scored = F.transform(known, lambda v: F.struct(v["name"].alias("name"), F.coalesce(similarity(F.lower(v["name"]), q), F.lit(0.0)).alias("likeness")))
    return F.filter(scored, lambda v: (q != "") & ((v["likeness"] > NEAR) | F.contains(F.lower(v["name"]), q) | F.contains(q, F.lower(v["name"]))))


def default_address(venue: Column, city: Column) -> Column:
    return F.concat(venue, F.lit(", "), or_else(city, F.lit("Austin, TX")))


def tidy_address(address: Column, city: Column) -> Column:
    """Parts trimmed and joined by commas; without a comma the city is added."""
    full = F.when(F.contains(address, F.lit(",")), address).otherwise(F.concat(address, F.lit(", "), or_else(city, F.lit("Austin, TX"))))
    return F.array_join(F.filter(F.transform(F.split(full, ","), lambda p: F.trim(p)), lambda p: p != ""), ", ")


def better_address(address: Column, venue: Column, city: Column, known: Column) -> Column:
    """The address itself if it names a street and a number, else the known venue's, else a default."""
    street = text(address).rlike(STREET_WORDS) & text(address).rlike(r"\d")
    return F.when(street, tidy_address(address, city)).otherwise(F.coalesce(lookup(venue, city, known), default_address(venue, city)))


#: Phrases of pages that block a visitor.
BLOCKING = [
    "access denied", "you have been blocked", "please complete the security check", "cloudflare security", "are you a robot?", "suspicious activity detected", "403 forbidden", "rate limit exceeded", "too many requests",
    "please verify you are human", "attention required! cloudflare", "checking your browser before accessing", "just a moment please", "security check in progress",
]


def looks_blocked(content: Column, title: Column) -> Column:
    """A blocking phrase in content or title, or words of such pages together; never a page of the ticket site that names events or tickets."""
    c, t = F.lower(text(content)), F.lower(text(title))
    has = lambda x, w: F.contains(x, F.lit(w))
    together = (has(c, "cloudflare") & has(c, "security")) | (has(c, "checking") & has(c, "browser")) | has(t, "access denied") | has(t, "forbidden")
    known = has(c, "eventbrite") & (has(c, "event") | has(c, "ticket"))
    return (contains_any(c, BLOCKING) | contains_any(t, BLOCKING) | together) & ~known


#: Hosts of sites, in order.
SITE_HOSTS = [
    (r"eventbrite\.", "eventbrite"), (r"ticketmaster\.", "ticketmaster"), (r"(facebook\.|fb\.|m\.facebook\.)", "facebook"), *((rf"{s}\.", s) for s in ("meetup", "do512", "sfstation", "funcheap", "universe", "brownpapertickets", "bandsintown", "songkick", "foursquare", "yelp", "timeout", "eventful")),
]
#: Words of hosts (h) and paths (p) and the kind of site, in order.
SITE_KINDS = [
    ("h", ["eventbrite"], "eventbrite"), ("h", ["ticketmaster"], "ticketmaster"), ("h", ["facebook", "fb.me"], "facebook"), *(("h", [s], s) for s in ("meetup", "do512", "sfstation", "funcheap")), ("h", ["getty.edu"], "getty"), ("h", ["tickets."], "ticketing"),
    ("p", ["ticket", "/buy"], "ticketing"), ("h", ["seatgeek", "stubhub"], "ticketing"),
]


def site_kind(url: Column) -> Column:
    """Kind of site by words of host and path, in order, else 'generic'."""
    host, path = (F.lower(F.regexp_extract(text(url), p, 1)) for p in (r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"))
    rules = [(contains_any(host if where == "h" else path, words), F.lit(kind)) for where, words, kind in SITE_KINDS]
    return first_match([*rules, (F.contains(host, F.lit("vivid")) & F.contains(host, F.lit("seats")), F.lit("ticketing"))], F.lit("generic"))


def site_type(url: Column, hosts: list[tuple[str, str]]) -> Column:
    """First site whose pattern the host matches, else 'generic'."""
    host = F.lower(F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    out = F
    for pattern, name in hosts:
        out = out.when(host.rlike(pattern), name)
    return out.otherwise("generic") if hosts else F.lit("generic")

