"""Column functions that read fields out of urls, pages, payloads and numbers as people write them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions import fixed
from staylens.functions.text import contains_any, squeeze, strip

_HOTEL_KEYS = ["hotelId", "hotel_id", "hotelid", "objectId", "object_id"]


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def hotel_id(url: Column) -> Column:
    """The hotel's number in a url: of a known query key, of a HOTEL part, or at the end of the slug."""
    by_key = [_found(_found(url, rf"[?&]{key}=([^&#]*)"), r"(\d{5,})") for key in _HOTEL_KEYS]
    return F.coalesce(*by_key, _found(url, r"HOTEL\.(\d{5,})"), _found(url, r"-(\d{5,})(?:/|\?|$)"), F.lit(""))


def absolute_url(url: Column, host: str) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(url.startswith("http"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(host), url)).otherwise(F.concat(F.lit(host + "/"), url))


def page_targets(html: Column) -> Column:
    """The hotel specs that a page names, decoded, each once: array of (spec, hotel_id, name)."""
    specs = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"spec=([^\"'&<> ]*HOTEL\.[^\"'&<> ]*)"), 1), lambda s: F.try_url_decode(s)))
    slug = lambda s: F.regexp_extract(s, r"HOTEL\.\d+\.(.*?)(?:\.\d+)?$", 1)
    return F.transform(specs, lambda s: F.struct(s.alias("spec"), F.regexp_extract(s, r"HOTEL\.(\d+)", 1).alias("hotel_id"), F.replace(slug(s), F.lit("-"), F.lit(" ")).alias("name")))


def number(text: Column) -> Column:
    """A number with a decimal point or comma, null if it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def score_to_5(text: Column) -> Column:
    """A score on a scale of five with one decimal, as text; above 5 it is on a scale of ten; else empty.

    Halves of tenths are rounded as their binary values ask for, which no built-in rounding does:
    the halves of 5.1 to 10.0 are looked up in a table made by the rule itself.
    """
    value = number(text)
    halves = F.create_map(*[F.lit(x) for n in range(51, 101) for x in (n / 10, str(round(n / 10 / 2, 1)))])
    return F.when(value.isNull() | F.isnan(value), "").when(value > 5, F.coalesce(F.try_element_at(halves, value), F.format_string("%.1f", F.bround(value / 2, 1)))).otherwise(F.format_string("%.1f", F.bround(value, 1)))


def iso_timestamp(epoch: Column) -> Column:
    """Seconds or milliseconds since 1970 as ISO 8601 text in UTC; what isn't a whole number stays as it is."""
    value = epoch.cast("string").try_cast("long")
    seconds = F.when(value > 1_000_000_000_000, F.floor(value / 1000)).otherwise(value)
    return F.coalesce(F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), epoch.cast("string"))


def review_id(source: str, hotel: Column, source_review_id: Column, text: Column, rating: Column, timestamp: Column) -> Column:
    """The source's own number, or one made of the content."""
    own = F.coalesce(source_review_id, F.lit(""))
    made = F.substring(F.sha1(F.concat_ws("|", hotel, F.lower(strip(F.coalesce(text, F.lit("")))), F.coalesce(rating, F.lit("")), F.coalesce(timestamp, F.lit("")))), 1, 16)
    return F.concat_ws("_", F.lit(source), hotel, F.when(own != "", own).otherwise(made))


def name_key(name: Column) -> Column:
    """A name to compare by: lower case, & as and, only letters, digits and apostrophes."""
    low = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and "))
    return squeeze(F.regexp_replace(low, "[^0-9a-zA-ZÀ-ỹđĐ' ]+", " "))


def is_address(text: Column, city: Column) -> Column:
    """Whether a text may be an address in the city: of fit length, with a sign of one and none of a review."""
    value = squeeze(F.coalesce(text, F.lit("")))
    low = F.lower(value)
    sign = value.contains(",") | value.rlike(r"\p{Nd}") | contains_any(low, fixed.ADDRESS_WORDS)
    return F.length(value).between(10, 160) & low.contains(F.lower(F.coalesce(city, F.lit("")))) & ~contains_any(low, fixed.REVIEW_LIKE) & sign


def declared_type(jsonld_type: Column) -> Column:
    """The kind of lodging that a type of linked data means; null if none."""
    value = F.regexp_replace(F.lower(squeeze(F.coalesce(jsonld_type, F.lit("")))), "schema.org/|place", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in fixed.DECLARED_LODGING.items() for x in pair]), value)


def page_types(declared: Column, page_text: Column, name: Column) -> Column:
    """Kinds of lodging: the declared one, else the first that the page speaks of; a plain hotel gets those in its name too."""
    low = F.lower(F.coalesce(page_text, F.lit("")))
    spoken = F.coalesce(*[F.when(contains_any(low, words), kind) for kind, words in fixed.PAGE_LODGING.items()], F.lit("hotel"))
    base = F.coalesce(declared_type(declared), spoken)
    low_name = F.lower(F.coalesce(name, F.lit("")))
    named = F.array_compact(F.array(*[F.when(contains_any(low_name, words), kind) for kind, words in fixed.NAME_LODGING.items()]))
    return F.when(base == "hotel", F.concat(F.array(F.lit("hotel")), named)).otherwise(F.array(base))


def is_candidate(url: Column, domain: str) -> Column:
    """Whether a url may lead to a hotel's page of the domain."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.contains(domain) & (low.contains("/hotel/") | low.contains("hotel."))


def detail_url(path: Column, host: str) -> Column:
    """A hotel's page from the path that lists give for it; a whole url stays, nothing gives nothing."""
    value = strip(F.coalesce(path, F.lit("")))
    return F.when((value == "") | value.rlike("^https?://"), value).otherwise(F.concat(F.lit(host + "/"), F.regexp_replace(value, "^/+", "")))


def search_url(host: str, geo_id: Column, name: Column, start: Column) -> Column:
    """The search page of a place for the night after a day."""
    day = lambda n: F.date_format(F.date_add(start, n), "dd-MM-yyyy")
    spec = F.concat_ws(".", day(1), day(2), F.lit("1.1.HOTEL_GEO"), geo_id, F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("1"))
    return F.concat(F.lit(f"{host}/hotel/search?spec="), spec)


def anchor_targets(html: Column, host: str) -> Column:
    """The hotel links of a page's anchors: array of (url, hotel_id), those with a heading in them first, each url and each hotel once."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), 0)
    with_heading = lambda a: a.rlike(r"(?i)<h3\b")
    urls = F.transform(F.concat(F.filter(anchors, with_heading), F.filter(anchors, lambda a: ~with_heading(a))), lambda a: absolute_url(F.regexp_extract(a, r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), host))
    domain = host.split("//")[-1]
    found = F.transform(F.array_distinct(F.filter(urls, lambda u: is_candidate(u, domain))), lambda u: F.struct(u.alias("url"), hotel_id(u).alias("hotel_id")))
    first = F.transform(found, lambda x, i: F.struct(x["url"].alias("url"), x["hotel_id"].alias("hotel_id"), i.alias("i")))
    ids = F.transform(found, lambda x: x["hotel_id"])
    once = F.filter(first, lambda x: (x["hotel_id"] == "") | (F.array_position(ids, x["hotel_id"]) == x["i"] + 1))
    return F.transform(once, lambda x: F.struct(x["url"], x["hotel_id"]))


def page_location(html: Column, city: Column) -> Column:
    """Where a hotel is by its page: the first address in it that is_address() takes, else the city.

    Addresses come from linked data, then from elements whose class, item or test id says so, then
    from any span or div without elements of its own.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    linked = F.transform(scripts, address_in)
    inner = lambda pattern: F.transform(F.regexp_extract_all(html, F.lit(pattern), 2), lambda e: squeeze(F.regexp_replace(e, "<[^>]*>", " ")))
    said = inner(r"(?is)<(\w+)\b[^>]*(?:data-testid|class|itemprop)\s*=\s*[\"'][^\"']*(?:address|location)[^\"']*[\"'][^>]*>(.*?)</\1>")
    plain = inner(r"(?is)<(span|div)\b[^>]*>([^<]*)</\1>")
    found = F.filter(F.concat(linked, said, plain), lambda x: is_address(x, city))
    return F.coalesce(squeeze(F.get(found, F.lit(0))), city)


def address_in(linked: Column) -> Column:
    """The parts of the address in a linked-data text, joined; also one level down in its graph or list. Empty where there is none."""
    parts = [F.coalesce(*[squeeze(F.get_json_object(linked, f"{root}.address.{part}")) for root in ("$", "$['@graph'][0]", "$[0]")]) for part in fixed.ADDRESS_PARTS]
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), ", ")


def linked_type(html: Column) -> Column:
    """The first kind of lodging that a page's linked data declares, in the data itself or in its graph; null if none."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    kinds = "array<struct<`@type`:string>>"
    of = lambda s: F.concat(F.array(F.get_json_object(s, "$['@type']")), F.coalesce(F.from_json(F.get_json_object(s, "$['@graph']"), kinds)["@type"], F.array().cast("array<string>")), F.coalesce(F.from_json(s, kinds)["@type"], F.array().cast("array<string>")))
    known = F.filter(F.flatten(F.transform(scripts, of)), lambda t: declared_type(t).isNotNull())
    return F.get(known, F.lit(0))


def jsonld(html: Column, path: str) -> Column:
    """A value in the first linked-data script of a page."""
    script = F.regexp_extract(html, r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    return F.get_json_object(F.nullif(script, F.lit("")), path)


PAYLOAD = "struct<data:struct<reviews:array<struct<reviewId:string,reviewOriginalText:string,translationStatus:string,reviewScore:string,reviewTimestamp:string,reviewReply:struct<replyOriginalText:string,replyContentText:string,replyText:string>>>,hasNext:boolean,nextCursor:string>>"


def payload_reviews(payload: Column) -> Column:
    """The reviews of a captured answer, as an array; null if it can't be read."""
    return F.from_json(payload, PAYLOAD)["data"]["reviews"]


def original_reviews(payload: Column) -> Column:
    """The reviews of a captured answer that count: originals of more than ten characters, not their own reply, not taken over from elsewhere."""

    def counts(r: Column) -> Column:
        said = strip(F.coalesce(r["reviewOriginalText"], F.lit("")))
        reply = strip(F.coalesce(*[F.nullif(r["reviewReply"][c], F.lit("")) for c in ("replyOriginalText", "replyContentText", "replyText")], F.lit("")))
        return (F.upper(F.coalesce(r["translationStatus"], F.lit(""))) == "ORIGINAL") & (F.length(said) > 10) & ((reply == "") | (said != reply)) & ~F.upper(strip(F.coalesce(r["reviewId"], F.lit("")))).startswith("EXPEDIA-")

    return F.filter(payload_reviews(payload), counts)


_NAME_KEYS = ["hotelName", "name", "displayName", "title", "label"]


_TARGETS = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("name", T.StringType())]))


@F.pandas_udf(_TARGETS)
def json_targets(payloads: pd.Series) -> pd.Series:
    """The hotels that a JSON text names at any depth: each url under hotelSeoUrl once, with the name beside it or nearest above.

    The depth is unknown, which no built-in function walks; it is done without recursion, in batches.
    """

    def walk(text: str | None) -> list[dict]:
        try:
            todo = [(json.loads(text), "")] if text else []
        except ValueError:
            return []
        found: dict[str, str] = {}
        while todo:
            node, above = todo.pop()
            if isinstance(node, dict):
                name = next((str(node[k]) for k in _NAME_KEYS if isinstance(node.get(k), str) and node[k].strip()), above)
                url = node.get("hotelSeoUrl")
                if isinstance(url, str) and url.strip():
                    found.setdefault(url.strip(), name)
                todo += [(v, name) for v in reversed(list(node.values()))]
            elif isinstance(node, list):
                todo += [(v, above) for v in reversed(node)]
        return [{"url": u, "name": n} for u, n in found.items()]

    return payloads.map(walk)
