"""Column functions over texts: cleaning, keys, tokens, containment, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import TITLE_STOPWORDS

EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]+"
URL = r"(?i)https?://[^\s<>\"'()\[\]{}]+"
TRACKING = r"^(?i:utm_.*|fbclid|gclid|yclid)$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """Without emoji, with white space collapsed and none before punctuation."""
    return F.regexp_replace(collapse(F.regexp_replace(c, EMOJI, "")), r"(?U)\s+([,.:;!?])", "$1")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin("", "unknown", "null")


def post_key(external_id: Column, text: Column) -> Column:
    """What makes two posts the same: their id, else their text without regard to case and spacing."""
    return F.coalesce(F.concat(F.lit("external_id:"), external_id), F.concat(F.lit("text:"), F.lower(collapse(text))))


def merge_source_key(external_id: Column, text: Column) -> Column:
    return F.coalesce(external_id, F.concat(F.lit("text-sha256:"), F.left(F.sha2(F.lower(collapse(text)), 256), F.lit(16))))


def tokens(c: Column) -> Column:
    """Distinct Latin, Cyrillic and digit words, ё as е, without common words unless there are no others."""
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), F.lit(r"([a-zа-я0-9]+)"), F.lit(1)))
    rare = F.array_except(found, F.array(*map(F.lit, TITLE_STOPWORDS)))
    return F.when(F.size(rare) > 0, rare).otherwise(found)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller token set that the other holds; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def title_supported(title: Column, raw: Column, least: float = 0.5) -> Column:
    """Whether enough of the title's tokens occur in the text."""
    return tokens_supported(tokens(title), tokens(raw), least)


def tokens_supported(t: Column, r: Column, least: float = 0.5) -> Column:
    """title_supported() of the token sets of a title and a text."""
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, r)) / F.size(t) >= least).otherwise(F.lit(False))


def infer_title(raw: Column) -> Column:
    """The first sentence, cut at a word's end within 120 signs."""
    first = F.btrim(F.split(collapse(raw), r"[.!?]\s+", 2)[0], F.lit(" -|"))
    cut = F.regexp_replace(F.left(first, F.lit(120)), r"\s+\S*$", "")
    return F.coalesce(F.nullif(F.when(F.length(first) > 120, F.btrim(cut, F.lit(" -|"))).otherwise(first), F.lit("")), F.lit("Событие"))


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def _encoded(c: Column) -> Column:
    """As in a form, with ~ as it is and * not."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decoded(c: Column) -> Column:
    # a sign of percent that starts no byte stands for itself
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def normalize_url(c: Column) -> Column:
    """https, host in lower case without user and default port, no trailing slash, fragment or tracking; query parameters in order,
    decoded and encoded anew. Null if no URL."""
    c = F.regexp_replace(c, r"[.,;:!?)\]}»\"]+$", "")
    at = lambda k: F.regexp_extract(c, r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d{0,5}))?(?![^/?#])([^?#]*)(?:\?([^#]*))?(?:#.*)?$", k)
    port = F.coalesce(at(3).try_cast("int"), F.when(F.lower(at(1)) == "http", 80).otherwise(443))
    usual = F.when(F.lower(at(1)) == "http", 80).otherwise(443)
    host = F.concat(F.lower(at(2)), F.when(port == usual, "").otherwise(F.concat(F.lit(":"), port.cast("string"))))
    path = F.regexp_replace(at(4), "/+$", "")
    pairs = F.transform(F.filter(F.split(at(5), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.regexp_extract(p, "^[^=]*", 0)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    query = F.transform(F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING))), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
    whole = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when((at(2) != "") & (port <= 65535), whole)


def urls(*texts: Column) -> Column:
    """Distinct normalised URLs of the texts."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(f"({URL})"), F.lit(1)) for t in texts])
    return F.array_compact(F.array_distinct(F.transform(found, normalize_url)))


def owner_of(external_id: Column) -> Column:
    """The wall's owner in ids of the form vk:wall<owner>_<post>, else null."""
    return F.nullif(F.regexp_extract(external_id, r"^vk:wall([^_]*)", 1), F.lit(""))


def enum_value(c: Column, domain: tuple[str, ...]) -> Column:
    """The domain's spelling without regard to case; null is unknown, what isn't listed is other."""
    known = F.create_map(*[F.lit(x) for v in (*domain, "unknown", "other") for x in (v.lower(), v)])
    return F.when(c.isNull(), "unknown").otherwise(F.coalesce(F.try_element_at(known, F.lower(strip(c))), F.lit("other")))


def in_domain(c: Column, domain: tuple[str, ...]) -> Column:
    """The listed values in their order, repeats included; null if none."""
    few = F.filter(c, lambda x: x.isin(*domain))
    return F.when(F.size(few) > 0, few)


def cleaned_list(c: Column) -> Column:
    return F.filter(F.transform(c, strip), lambda x: x != "")
