"""Forms of dates, times, prices and venues in noisy text, as tables of (field, family, pattern).

Fixed values: the patterns, in the order in which they are tried, and what each
family is worth. ``[A-Z]`` and word boundaries are ASCII. Forms that can match
but never give a value ("USD 25", "VIP $50", "general $25", a reversed "Theater
Name", a range of three groups) are left out, as are those whose every match
another form of the same family gives with the same value.
"""

from __future__ import annotations

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
_MONTH, _MON = "|".join(MONTHS), "|".join(m[:3] for m in MONTHS)
_DAY, _DY = "|".join([*WEEKDAYS[1:], WEEKDAYS[0]]), "|".join(d[:3] for d in [*WEEKDAYS[1:], WEEKDAYS[0]])
_TH = "(?:st|nd|rd|th)?"
_AMOUNT = r"(\d+(?:\.\d{2})?)"
_PERIOD = "(AM|PM|am|pm)"
_NAME = r"[A-Z][A-Za-z\s&',.-]"
_PLACE = "Theater|Theatre|Club|Bar|Lounge|Hall|Arena|Stadium|Center|Centre|Auditorium|Pavilion|Garden|Gardens|Hotel|Casino|Restaurant|Cafe|Gallery|Museum|Library|Church|Temple"
_STREET = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Circle|Cir|Court|Ct|Place|Pl"

#: Groups: month, day, year; of dayOfWeek weekday, month, day, year; of relative the words; of ordinal day, month, year.
DATES = [
    ("date", "fullMonth", rf"(?i)\b({_MONTH})\s+(\d{{1,2}}){_TH}\s*,?\s*(\d{{4}})\b"),
    ("date", "fullMonth", rf"(?i)\b({_MONTH})\s+(\d{{1,2}}){_TH}\b"),
    ("date", "abbrMonth", rf"(?i)\b({_MON})\.?\s+(\d{{1,2}}){_TH}\s*,?\s*(\d{{4}})\b"),
    ("date", "abbrMonth", rf"(?i)\b({_MON})\.?\s+(\d{{1,2}}){_TH}\b"),
    ("date", "numeric", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"),
    ("date", "numeric", r"\b(\d{1,2})/(\d{1,2})/(\d{2})\b"),
    ("date", "numeric", r"\b(\d{1,2})-(\d{1,2})-(\d{4})\b"),
    ("date", "numeric", r"\b(\d{1,2})-(\d{1,2})-(\d{2})\b"),
    ("date", "dayOfWeek", rf"(?i)\b({_DAY})\s+({_MONTH})\s+(\d{{1,2}}){_TH}\s*,?\s*(\d{{4}})?\b"),
    ("date", "dayOfWeek", rf"(?i)\b({_DY})\.?\s+({_MON})\.?\s+(\d{{1,2}}){_TH}\s*,?\s*(\d{{4}})?\b"),
    ("date", "relative", r"(?i)\b(today|tonight)\b"),
    ("date", "relative", r"(?i)\b(tomorrow)\b"),
    ("date", "relative", rf"(?i)\b(this\s+(?:{_DAY}))\b"),
    ("date", "relative", rf"(?i)\b(next\s+(?:{_DAY}))\b"),
    ("date", "ordinal", rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)\s+({_MONTH})\s*,?\s*(\d{{4}})?\b"),
    ("date", "ordinal", rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)\s+of\s+({_MONTH})\s*,?\s*(\d{{4}})?\b"),
]
#: Groups: hour, minute, period; of military hour, minute, second; of ranges those of both ends.
TIMES = [
    ("time", "standard12", r"(?i)\b(\d{1,2}):?(\d{2})?\s*(AM|PM|am|pm|a\.m\.|p\.m\.)\b"),
    ("time", "military", r"\b([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?\b"),
    ("time", "military", r"(?i)\b(2[0-4]|[01]?\d)([0-5]\d)\s*(?:hours?|hrs?|h)?\b"),
    ("time", "ranges", rf"(?i)\b(\d{{1,2}}):?(\d{{2}})?\s*{_PERIOD}?\s*[-–—]\s*(\d{{1,2}}):?(\d{{2}})?\s*{_PERIOD}\b"),
    ("time", "doors", rf"(?i)\b(?:doors?|door)\s*(?:open|at)?\s*(\d{{1,2}}):?(\d{{2}})?\s*{_PERIOD}?\b"),
    ("time", "show", rf"(?i)\b(?:show|performance|concert|event|starts?)\s*(?:at|@)?\s*(\d{{1,2}}):?(\d{{2}})?\s*{_PERIOD}?\b"),
    ("time", "casual", rf"(?i)\b(?:around|about|approximately|~|circa)\s*(\d{{1,2}}):?(\d{{2}})?\s*{_PERIOD}?\b"),
    ("time", "contextual", rf"(?i)\b(?:at|@)\s*(\d{{1,2}}):?(\d{{2}})?\s*{_PERIOD}\b"),
]
#: Groups: the amount, or both of a range; of tiered the amount and the tier.
PRICES = [
    ("price", "free", r"\b(free|FREE|Free)\b"),
    ("price", "free", r"(?i)\b(no charge|no cost|complimentary|gratis)\b"),
    ("price", "free", r"(?i)\b(admission free|free admission|free entry)\b"),
    ("price", "free", r"\$0\.?00?"),
    ("price", "single", rf"\${_AMOUNT}\b"),
    ("price", "single", rf"{_AMOUNT}\s*\$\b"),
    ("price", "single", rf"(?i)\b{_AMOUNT}\s*(dollars?|bucks?)\b"),
    ("price", "ranges", rf"\${_AMOUNT}\s*[-–—]\s*\$?{_AMOUNT}"),
    ("price", "ranges", rf"{_AMOUNT}\s*[-–—]\s*{_AMOUNT}\s*\$\b"),
    ("price", "ranges", rf"(?i)\${_AMOUNT}\s*(?:to|through)\s*\$?{_AMOUNT}"),
    ("price", "starting", rf"(?i)(?:starting\s*(?:at|from)|from)\s*\${_AMOUNT}"),
    ("price", "starting", rf"\${_AMOUNT}\+"),
    ("price", "starting", rf"(?i)(?:as\s*low\s*as|minimum)\s*\${_AMOUNT}"),
    ("price", "maximum", rf"(?i)(?:up\s*to|maximum|max)\s*\${_AMOUNT}"),
    ("price", "maximum", rf"(?i)(?:under|less\s*than|below)\s*\${_AMOUNT}"),
    ("price", "contextual", rf"(?i)(?:tickets?|admission|cover|entry|cost)\s*:?\s*\${_AMOUNT}"),
    ("price", "contextual", rf"(?i)\${_AMOUNT}\s*(?:tickets?|admission|cover|entry)"),
    ("price", "tiered", rf"(?i)\${_AMOUNT}\s*(general|adult|regular|standard)"),
    ("price", "tiered", rf"(?i)\${_AMOUNT}\s*(student|senior|child|youth)"),
    ("price", "timing", rf"(?i)\${_AMOUNT}\s*(?:advance|pre-?sale|early)"),
    ("price", "timing", rf"(?i)\${_AMOUNT}\s*(?:door|day\s*of)"),
    ("price", "timing", rf"(?i)(?:advance|pre-?sale|early)\s*\${_AMOUNT}"),
    ("price", "timing", rf"(?i)(?:door|day\s*of|at\s*door)\s*\${_AMOUNT}"),
]
#: Groups: the name; of venueTypes an article, the name and the type; of addresses number, name and type; of locations city and state.
VENUES = [
    ("venue", "atVenue", rf"\b(?:at|@)\s+({_NAME}{{3,50}})"),
    ("venue", "atVenue", rf"(?i)\b(?:venue|location):\s*({_NAME}{{3,50}})"),
    ("venue", "venueTypes", rf"(?i)\b(The\s+)?({_NAME}{{1,30}})\s+({_PLACE})\b"),
    ("venue", "addresses", rf"(?i)\b(\d{{1,5}})\s+([A-Z][A-Za-z\s]{{2,30}})\s+({_STREET})\b"),
    ("venue", "addresses", r"\b(\d{1,5})\s+([A-Z][A-Za-z\s]{2,30})\b"),
    ("venue", "liveAt", rf"(?i)\b(?:live|performing|playing|appearing)\s+(?:at|@)\s+({_NAME}{{3,50}})"),
    ("venue", "properNouns", r"\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){1,4})\b"),
    ("venue", "locations", r"\bin\s+([A-Z][A-Za-z\s]{2,30}),?\s*([A-Z]{2}|\b[A-Z][A-Za-z\s]{2,20})\b"),
    ("venue", "locations", r"\b([A-Z][A-Za-z\s]{2,30}),\s*([A-Z]{2})\b"),
]
ALL = DATES + TIMES + PRICES + VENUES
#: By a part of a pattern, in order, what any match of it has one of, in lower case.
NEEDED = [
    ("[-–—]", ("-", "–", "—")), (r"\d{1,2})/(", ("/",)), (r"\d{1,2})-(", ("-",)), ("today", ("today", "tonight")), ("tomorrow", ("tomorrow",)), (r"this\s", ("this",)), (r"next\s", ("next",)), (r"\s+of\s+", ("of",)), ("(?:st|nd|rd|th)\\s", ("st", "nd", "rd", "th")),
    ("doors?|door)", ("door",)), ("starts?)", ("show", "performance", "concert", "event", "start")), ("circa", ("around", "about", "approximately", "~", "circa")), ("live|", ("live", "performing", "playing", "appearing")), ("venue|location", ("venue", "location")),
    (r"in\s+([A-Z]", ("in",)), ("(?:at|@)", ("at", "@")), ("(free|", ("free",)), ("no charge", ("no c", "compl", "gratis")), ("admission free", ("free",)), (r"\$0\.", ("$0",)), ("dollars", ("dollar", "buck")), ("(?:to|through)", ("to", "through")), ("starting", ("from", "starting")), (")?)\\+", ("+",)),
    ("minimum", ("low", "minimum")), ("maximum", ("up", "max")), ("under|", ("under", "less", "below")), (":?\\s*\\$", ("ticket", "admission", "cover", "entry", "cost")), ("(?:tickets?|", ("ticket", "admission", "cover", "entry")), ("general", ("general", "adult", "regular", "standard")),
    ("student", ("student", "senior", "child", "youth")), ("advance", ("advance", "pre", "early")), (r"day\s*of", ("door", "day")), (r"([A-Z]{2})\b", (",",)),
]
#: Characters of context that each field looks at on either side.
CONTEXT = {"date": 20, "time": 30, "price": 40, "venue": 50}

#: Confidences of families before anything else is known of a match.
BASE = {
    "date": {"fullMonth": 0.9, "abbrMonth": 0.8, "dayOfWeek": 0.85, "ordinal": 0.85, "numeric": 0.7, "relative": 0.95},
    "time": {"standard12": 0.9, "military": 0.95, "ranges": 0.85, "doors": 0.8, "show": 0.85, "casual": 0.7, "contextual": 0.75},
    "price": {"free": 0.95, "single": 0.9, "ranges": 0.85, "starting": 0.8, "maximum": 0.75, "contextual": 0.85, "tiered": 0.8, "timing": 0.8},
    "venue": {"atVenue": 0.95, "venueTypes": 0.9, "liveAt": 0.85, "addresses": 0.8, "fuzzy": 0.85, "locations": 0.6, "properNouns": 0.3},
}
#: Weights of families when fields are weighed against each other; families that are not named (ranges, fuzzy) weigh 1.
WEIGHTS = {
    "date": {"fullMonth": 1.0, "abbrMonth": 0.9, "dayOfWeek": 0.85, "ordinal": 0.8, "numeric": 0.7, "relative": 0.95},
    "time": {"standard12": 1.0, "military": 0.95, "doors": 0.75, "show": 0.8, "casual": 0.6, "contextual": 0.7},
    "price": {"free": 1.0, "single": 0.9, "starting": 0.7, "maximum": 0.65, "contextual": 0.8, "tiered": 0.75, "timing": 0.8},
    "venue": {"atVenue": 1.0, "venueTypes": 0.95, "liveAt": 0.9, "addresses": 0.7, "locations": 0.5, "properNouns": 0.3},
}
FIELD_WEIGHTS = {"date": 0.3, "time": 0.25, "price": 0.2, "venue": 0.25}
IMPORTANT = ["event", "show", "concert", "performance", "when", "where", "cost", "price", "tickets", "admission", "doors", "venue", "location", "at", "on", "date", "time", "starts", "begins"]

EARLY = ["early", "matinee", "morning", "breakfast", "lunch"]
PRICE_WORDS = ["ticket", "admission", "cover", "entry", "cost"]
TIERS = {"general": ["general", "adult", "regular", "standard"], "student": ["student", "senior", "child", "youth", "kid"], "premium": ["vip", "premium", "special", "deluxe"]}
TIMING = {"advance": ["advance", "pre-sale", "presale", "early"], "door": ["door", "day of", "walk-in"]}

VENUE_WORDS = ["at", "@", "venue", "location", "live", "performing", "playing", "appearing"]
VENUE_TYPES = [
    "theater", "theatre", "club", "bar", "pub", "lounge", "hall", "arena", "stadium", "center", "centre", "auditorium", "pavilion", "garden", "gardens", "hotel", "casino", "restaurant", "cafe", "bistro", "grill",
    "gallery", "museum", "library", "church", "cathedral", "temple", "ballroom", "convention", "conference", "civic", "community", "cultural", "performing", "music", "opera", "symphony", "amphitheater", "coliseum",
]
STOP_WORDS = (
    "the and or but with for on in at by to from up about into through during before after above below between among under over again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very can will just should now event show concert performance tickets admission doors pm am date time price cost free tonight today tomorrow"
).split() + [w.lower() for w in [*WEEKDAYS, *MONTHS]]
