"""Scores of images from their URL and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.common import contains_any, matched
from marquee.functions.validators import valid_image_url

#: What URLs say, and the points for it.
HIGH_RES = r"(?i)(_high|_large|_big|_hd|_xl|_original|\d{4,}x\d{4,})"
THUMBNAIL = r"(?i)(_thumb|_small|_mini|_tiny|_xs|thumbnail|thumb|\d{1,3}x\d{1,3})"
PRIORITY = [(HIGH_RES, 20), (THUMBNAIL, -30), ("(?i)(event|hero|featured|main|primary|banner|poster)", 15), ("(?i)(logo|icon|avatar|profile|nav|ad|sponsor)", -25), ("(?i)(cdn|cloudfront|amazonaws|imgix|cloudinary)", 5)]
#: Ratios width/height with the score near them.
RATIOS = [(1.0, 100), (0.8, 95), (0.5625, 90), (0.618, 85)]


def url_priority(url: Column) -> Column:
    parts = [F.when(url.rlike(p), n).otherwise(0) for p, n in PRIORITY]
    return sum(parts[1:], parts[0])


def extension(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)\.([a-z0-9]+)(?:\?|$)", 1)), F.lit(""))


def analysis(url: Column) -> Column:
    """Struct of extension, high_res, thumbnail and priority; null for other than image URLs."""
    parts = F.struct(extension(url).alias("extension"), url.rlike(HIGH_RES).alias("high_res"), url.rlike(THUMBNAIL).alias("thumbnail"), url_priority(url).alias("priority"))
    return F.when(valid_image_url(url), parts)


def url_key(url: Column) -> Column:
    """The URL without size words, sizes and query."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "(?i)(_thumb|_small|_large|_hd|_xl)", ""), r"(?i)\d+x\d+", ""), "[?&].*$", "")


def ratio_score(ratio: Column) -> Column:
    out = F.when(ratio.isNull() | (ratio <= 0), 0.0)
    for ideal, score in RATIOS:
        out = out.when(F.abs(ratio - ideal) < 0.05, float(score))
    near = F.greatest(F.lit(60.0), 80 - F.abs(ratio - 1.0) * 100)
    return out.when((ratio >= 0.7) & (ratio <= 1.3), near).when((ratio > 1.3) & (ratio < 2.0), 30.0).when((ratio < 0.5) | (ratio > 2.0), 10.0).otherwise(40.0)


def size_score(width: Column, height: Column, least: int = 300, ideal_width: int = 600, ideal_height: int = 600) -> Column:
    pixels = width.cast("double") * height / (1024 * 1024)
    large = F.when(pixels >= 1.0, 100).when(pixels >= 0.5, 90).otherwise(80)
    return F.when((width >= ideal_width) & (height >= ideal_height), large).when((width >= least) & (height >= least), F.when(pixels >= 0.3, 70).otherwise(60)).otherwise(20)


#: What selectors say, in order, and the priority for it.
SELECTORS = [(["og:image", "twitter:image"], 100), (["event", "banner", "hero"], 80), (["featured", "poster", "flyer"], 70), (["main", "primary"], 60)]


def selector_priority(selector: Column) -> Column:
    out = F
    for words, n in SELECTORS:
        out = out.when(contains_any(selector, words), n)
    return out.when(selector == "img", 10).otherwise(50)


#: Words of promotional, of unwanted and of text-rich images, of quality, and of texts that can be read.
FLYER_WORDS = [
    "flyer", "poster", "banner", "promo", "promotional", "featured", "hero", "main", "primary", "cover", "eventbrite", "event-image", "listing-image", "card-image", "tile-image", "featured-image", "social-image", "share-image", "og-image",
]
AVOIDED_WORDS = ["thumb", "thumbnail", "small", "tiny", "icon", "avatar", "profile", "logo-only", "watermark", "preview", "crop", "snippet", "sample"]
TEXT_WORDS = ["lineup", "schedule", "details", "info", "information", "text", "readable", "clear", "sharp", "high-res", "announcement", "advertisement", "ticket", "pricing"]
QUALITY_WORDS = ["hd", "high-res", "quality", "sharp", "clear"]
READABLE = ["when:", "where:", "time:", "date:", "venue:", "tickets:", "artists:", "lineup:", "schedule:", "details:", "info:", "price:", "cost:", "admission:", "entry:", "doors:"]
CDNS = ["cdn.", "cloudinary", "imgix", "fastly", "cloudflare", "amazonaws", "s3.", "firebase", "googleusercontent"]
#: Forms of sizes in URLs, in order.
SIZES = [
    r"(?i)[?&]w=(\d+)[&.].*[?&]h=(\d+)", r"(?i)[?&]width=(\d+)[&.].*[?&]height=(\d+)", r"/(\d+)x(\d+)/", r"_(\d+)x(\d+)\.", r"(?i)(\d+)x(\d+)\.(?:jpg|png|webp)", r"(?i)resize[=:](\d+)[x,:](\d+)", r"(\d{3,4})x(\d{3,4})",
]
#: Weights of the parts of an image's score, and what they are multiplied by where OCR counts for a tenth.
WEIGHTS, WITH_OCR = {"ratio": 0.4, "size": 0.25, "flyer": 0.2, "quality": 0.1, "context": 0.05}, 0.9
LEAST_SIDE, OCR_LEAST, OCR_IDEAL, OCR_SUITABLE = 300, 400, 800, 60


def dimensions(url: Column) -> Column:
    """Struct of width and height from the first form of size in a URL with both sides over 50 and under 5000; zeros without."""
    sane = lambda w, h: F.when((w > 50) & (w < 5000) & (h > 50) & (h < 5000), F.struct(w.alias("width"), h.alias("height")))
    return F.coalesce(*(matched(url, p, 2, lambda w, h: sane(w.try_cast("int"), h.try_cast("int"))) for p in SIZES), F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def _points(c: Column, n: int) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)


def flyer_score(url: Column, title: Column) -> Column:
    """0 to 100: words of promotion, of heroes, of sharing, of the title; less for words of thumbnails."""
    u, t = F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    named = (F.length(t) > 3) & F.exists(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 3), lambda w: F.contains(u, w))
    return _clamped(_points(contains_any(u, FLYER_WORDS), 30) + _points(contains_any(u, ["featured", "hero"]), 20) + _points(contains_any(u, ["og-image", "social"]), 15) - _points(contains_any(u, AVOIDED_WORDS), 50) + _points(named, 10))


def is_flyer(url: Column) -> Column:
    return contains_any(F.lower(url), [*FLYER_WORDS, "social"])


def ocr_dimension_score(width: Column, height: Column) -> Column:
    """0 without a size, 10 if too small to read, else 60 with up to 30 for size and 10 for a ratio near a square's."""
    size = F.when((width >= OCR_IDEAL) & (height >= OCR_IDEAL), 30).when((width >= OCR_LEAST * 1.5) & (height >= OCR_LEAST * 1.5), 20).otherwise(0)
    fine = F.least(F.lit(100), 60 + size + _points((width / height).between(0.7, 1.4), 10))
    return F.when((width == 0) | (height == 0) | width.isNull() | height.isNull(), 0).when((width < OCR_LEAST) | (height < OCR_LEAST), 10).otherwise(fine)


def ocr_keyword_score(url: Column) -> Column:
    u = F.lower(url)
    return _clamped(40 + _points(contains_any(u, TEXT_WORDS), 15) + _points(contains_any(u, FLYER_WORDS), 20) - _points(contains_any(u, ["thumb", "small", "icon", "preview"]), 30))


def ocr_text_score(url: Column) -> Column:
    u = F.lower(url)
    return _clamped(40 + _points(contains_any(u, READABLE), 20) + _points(contains_any(u, QUALITY_WORDS), 15))


def ocr_score(url: Column, width: Column, height: Column) -> Column:
    """Half by size, 0.3 by words, 0.2 by signs of text, rounded; OCR_SUITABLE or more is suitable."""
    return F.floor(ocr_dimension_score(width, height) * 0.5 + ocr_keyword_score(url) * 0.3 + ocr_text_score(url) * 0.2 + 0.5).cast("int")


def image_score(url: Column, width: Column, height: Column, title: Column, venue: Column, with_ocr: bool = False) -> Column:
    """Rounded weighted score of an image; null for one with a side under LEAST_SIDE."""
    from marquee.functions.fixes import image_context_score, image_quality_score

    ratio = width / height
    parts = {"ratio": ratio_score(ratio), "size": size_score(width, height), "flyer": flyer_score(url, title), "quality": image_quality_score(url, CDNS), "context": image_context_score(url, venue)}
    total = sum((v * WEIGHTS[k] * (WITH_OCR if with_ocr else 1.0) for k, v in parts.items()), F.lit(0.0))
    total = total + ocr_score(url, width, height) * 0.1 if with_ocr else total
    return F.when((width >= LEAST_SIDE) & (height >= LEAST_SIDE), F.floor(total + 0.5).cast("int"))


def web_image(url: Column) -> Column:
    """An http(s) URL that is no style sheet, script, data or document, and no tracking pixel."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    return F.coalesce(url.rlike(r"^(?i)https?://[^\s/?#]+") & ~path.rlike(r"\.(css|js|json|xml|txt|pdf)$") & ~contains_any(url, ["base64", "1x1", "pixel"]), F.lit(False))


def likely_image(url: Column) -> Column:
    """A URL with an image's ending in its path, or one whose path or host speaks of images."""
    host, path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    return F.coalesce((host != "") & (path.rlike(r"\.(jpg|jpeg|png|webp|gif)") | path.rlike("image|img|photo") | host.rlike("img|cdn")), F.lit(False))


def absolute_url(url: Column, base: Column) -> Column:
    """A URL resolved against the page's: absolute, without a protocol, from the root, or beside the page ('./' and '../' taken up); null for an empty one."""
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]*)*)/", 1)
    segments = F.split(F.concat(folder, F.lit("/"), F.regexp_replace(url, r"[?#].*$", "")), "/")
    back = F.aggregate(segments, F.array().cast("array<string>"), lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))))
    beside = F.concat(scheme, F.lit("://"), host, F.array_join(back, "/"), F.regexp_extract(url, r"([?#].*)$", 1))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(None)).when(url.startswith("http"), url).when(url.startswith("//"), F.concat(scheme, F.lit(":"), url)).when(url.startswith("/"), F.concat(scheme, F.lit("://"), host, url)).otherwise(beside)
