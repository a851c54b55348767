"""URLs: canonical form, safety, and what the shape of a URL says about its page."""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from verishelf.functions import vocab
from verishelf.functions.text import blank_to_null, first_match, let, strip, words

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no expression for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(url: Column) -> Column:
    """The URL composed (NFKC), its dashes as "-", without invisible characters. Python workers get
    the texts of URLs that aren't ASCII, and nulls for all others."""
    other = url.rlike("[^\\x00-\\x7F]")
    return F.translate(F.when(other, strip(nfkc(F.when(other, url)))).otherwise(strip(url)), vocab.DASHES + vocab.INVISIBLE, "-" * len(vocab.DASHES))


def scheme(url: Column) -> Column:
    return F.lower(first_match(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 2))


def host(url: Column) -> Column:
    """The host without user and port; an IPv6 address keeps its brackets."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def _form(c: Column) -> Column:
    """Form encoding as browsers and Python do it: ~ stays, * is escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def canonical(url: Column) -> Column:
    """One form for URLs of one page, or null if it isn't an http(s) URL with a host.

    Lower-case scheme and host without www., default port, fragment and tracking parameters;
    parameters sorted and encoded anew; a slash at the end only of the root. Characters are composed first.
    """
    return let(folded(url), _canonical)


def _canonical(u: Column) -> Column:
    name, port = F.regexp_replace(host(u), r"^www\.", ""), F.regexp_extract(netloc(u), r":(\d+)$", 1)
    default = F.when(scheme(u) == "https", "443").otherwise("80")
    place = F.when((port == "") | (port == default), name).otherwise(F.concat(name, F.lit(":"), port))
    trail = F.when(F.length(path(u)) > 1, F.regexp_replace(path(u), "/+$", "")).otherwise(path(u))
    pairs = F.filter(F.split(F.coalesce(F.regexp_extract(u, _SPLIT, 4), F.lit("")), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(_decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    own = F.filter(named, lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_")) & ~F.lower(p["k"]).isin(*vocab.TRACKING))
    query = F.array_join(F.transform(F.array_sort(own), lambda p: F.concat(_form(p["k"]), F.lit("="), _form(p["v"]))), "&")
    whole = F.concat(scheme(u), F.lit("://"), place, trail, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme(u).isin("http", "https") & (name != ""), whole)


def is_global(address: str) -> bool:
    """Whether a text is an IP address that all of the internet may reach."""
    try:
        return ipaddress.ip_address(address).is_global
    except ValueError:
        return False


@F.pandas_udf(BooleanType())
def _ipv6_private(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else not is_global(x.strip("[]")))


def private_host(name: Column) -> Column:
    """Whether a host is an address that isn't global, an address in an unusual spelling, or this machine's name.

    Unusual: a host whose last part is a number, in any base, and that isn't four decimal numbers
    from 0 to 255: readers may take 127.1 or 2130706433 for an address. IPv6 addresses, in brackets, go
    to Python workers, which get nulls for all other hosts.
    """
    brackets = F.coalesce(_ipv6_private(F.when(F.startswith(name, F.lit("[")), name)), F.lit(False))
    return let(F.regexp_replace(name, r"\.$", ""), _private) | brackets


def _private(bare: Column) -> Column:
    octet = lambda k: F.regexp_extract(bare, r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$", k).try_cast("int")
    a, b, c, d = octet(1), octet(2), octet(3), octet(4)
    quad = F.coalesce(F.greatest(a, b, c, d) <= 255, F.lit(False))
    inner = (
        a.isin(0, 10, 127)
        | (a >= 240)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & ((b == 168) | ((b == 0) & ((c == 2) | ((c == 0) & ~d.isin(9, 10))))))
        | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100))))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    number = bare.rlike(r"(?i)(^|\.)(\d+|0x[0-9a-f]*)$") & ~quad
    here = (bare == "localhost") | F.endswith(bare, F.lit(".localhost"))
    return F.coalesce(inner, F.lit(False)) | number | here


def safe(url: Column) -> Column:
    """Whether a URL may be fetched: it has a canonical form, and its host isn't private. What a name
    resolves to is checked where it is fetched, see adapters.fetch."""
    form = canonical(url)
    return F.when(form.isNull(), False).otherwise(~private_host(host(form)))


def _one_of(name: Column, domains: tuple[str, ...]) -> Column:
    return F.exists(words(domains), lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d)))


def first_word(brand: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(F.split(strip(brand), r"(?U)\s+"), F.lit(1)), F.lit("")))


def page_shape(url: Column) -> dict[str, Column]:
    """What a URL's shape says without a brand: flags, whether it is a site's root, its only segment."""
    low = F.lower(url)
    segments = F.filter(F.split(path(low), "/"), lambda s: s != "")
    name, only = netloc(low), F.try_element_at(segments, F.lit(1))
    flag = lambda cond, text: F.when(cond, F.lit(text))
    one = F.size(segments) == 1
    return {
        "_page_flags": F.array_compact(
            F.array(
                flag((name != "") & _one_of(name, vocab.DIRECTORIES), "directory"),
                flag(F.exists(words(vocab.LISTING_PATTERNS), lambda p: F.contains(low, p)), "listing_page"),
                flag((name != "") & _one_of(name, vocab.NON_COMMERCE), "non_commerce"),
            )
        ),
        "_root": (name != "") & ((F.size(segments) == 0) | (one & only.rlike("^[a-z]{2}(?:[-_][a-z]{2})?$"))),
        "_only": F.when((name != "") & one, only),
    }


def flags_of(token: Column, shape: dict[str, Column] | None = None) -> Column:
    """The flags of a page for a brand's first word; shape: the columns of page_shape, if they have other names."""
    s = shape or {c: F.col(c) for c in ("_page_flags", "_root", "_only")}
    own = (token != "") & ((s["_only"] == token) | (s["_only"] == F.replace(token, F.lit("-"), F.lit(""))))
    return F.array_compact(F.concat(s["_page_flags"], F.array(F.when(s["_root"] | F.coalesce(own, F.lit(False)), F.lit("site_root")))))


def shape_flags(url: Column, brand: Column) -> Column:
    """Flags of pages that are about a product, or a brand, and aren't its own."""
    return flags_of(first_word(brand), page_shape(url))


def about(url: Column, brand: Column) -> Column:
    return F.size(shape_flags(url, brand)) > 0


def url_title(url: Column) -> Column:
    return blank_to_null(path(url))
