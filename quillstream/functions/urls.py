"""URL algebra as column expressions: canonical form, comparison key, same site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, their prefixes, default ports and index files.
TRACKING_PARAMS = (
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "ttclid", "igshid", "igsh",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "vero_id", "oly_enc_id", "oly_anon_id", "ref_src", "ref_url", "cmpid",
    "ncid", "sr_share", "share_id", "si", "s_kwcid", "trk", "trkCampaign", "__twitter_impression",
)
TRACKING_PREFIXES = ("utm_", "at_", "pk_", "piwik_", "matomo_")
DEFAULT_PORTS = {"http": 80, "https": 443}
INDEX_FILES = ("index.html", "index.htm", "index.php", "default.html", "default.htm")

_SHAPE = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HOST = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:@\[\]]*)(?::(\d*))?$"


def _cleaned(url: Column) -> Column:
    """Without control characters and blanks at the ends, nor tabs and line breaks inside."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(url: Column, body) -> Column:
    """body(scheme, raw netloc, path, query) of a URL; empty parts where the URL has no such shape."""

    def of(u: Column) -> Column:
        return F.struct(F.lower(F.regexp_extract(u, _SHAPE, 1)).alias("s"), F.regexp_extract(u, _SHAPE, 2).alias("n"), F.regexp_extract(u, _SHAPE, 3).alias("p"), F.regexp_extract(u, _SHAPE, 4).alias("q"))

    return let(_cleaned(url), lambda u: let(of(u), lambda x: body(x["s"], x["n"], x["p"], x["q"])))


def is_tracking_param(name: Column) -> Column:
    """Whether a query parameter carries analytics; names are compared in lower case."""
    low = F.lower(name)
    return low.isin(*TRACKING_PARAMS) | low.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")


def _decode(text: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9a-fA-F]{2})", "%25"))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def strip_tracking_params(query: Column) -> Column:
    """The query without tracking parameters, sorted by name and value and encoded anew."""
    pieces = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.transform(
        pieces,
        lambda x: F.struct(
            _decode(F.substring_index(x, "=", 1)).alias("name"),
            _decode(F.when(x.contains("="), F.regexp_replace(x, r"(?s)^[^=]*=", "")).otherwise("")).alias("value"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking_param(p["name"])))
    return F.when(query == "", "").otherwise(F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))), "&"))


def _netloc(scheme: Column, raw: Column) -> Column:
    """Credentials, lower-case host and any port that isn't the scheme's default; null if not http(s), or for no or an invalid host."""

    def shown(x: Column) -> Column:
        user, host, port = x["u"], x["h"], x["p"]
        name, word = F.substring_index(user, ":", 1), F.regexp_replace(user, r"(?s)^[^:]*:?", "")
        credentials = F.when(name == "", "").otherwise(F.concat(name, F.when(word == "", "").otherwise(F.concat(F.lit(":"), word)), F.lit("@")))
        number = F.when(port == "", F.lit(None)).otherwise(port.try_cast("int"))
        default = F.when(scheme == "http", DEFAULT_PORTS["http"]).otherwise(DEFAULT_PORTS["https"])
        end = F.when(number.isNull() | (number == default), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        valid = scheme.isin("http", "https") & (host != "") & (host != "[]") & ((port == "") | F.coalesce(number.between(0, 65535), F.lit(False)))
        return F.when(valid, F.concat(F.when(user == "", "").otherwise(credentials), host, end))

    split = F.struct(F.regexp_extract(raw, _HOST, 1).alias("u"), F.lower(F.regexp_extract(raw, _HOST, 2)).alias("h"), F.regexp_extract(raw, _HOST, 3).alias("p"))
    return let(split, shown)


def _assemble(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.concat(scheme, F.lit("://"), netloc, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def is_public_url(url: Column) -> Column:
    """Whether url is absolute, http or https, and names a host."""
    return F.coalesce(_parts(url, lambda s, n, p, q: _netloc(s, n).isNotNull()), F.lit(False))


def canonicalize_url(url: Column) -> Column:
    """The publishable form: no fragment, tracking, default port or upper case in scheme and host; null if not public."""
    return _parts(url, lambda s, n, p, q: _assemble(s, _netloc(s, n), p, strip_tracking_params(q)))


def dedupe_key(url: Column) -> Column:
    """For comparison only: the canonical form without `www.`, index file and trailing slashes; null if not public."""
    index = r"(?i)(^|/)(" + "|".join(x.replace(".", r"\.") for x in INDEX_FILES) + r")$"

    def key(s: Column, n: Column, p: Column, q: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(p, index, "$1"), "/+$", "")
        return _assemble(s, F.regexp_replace(_netloc(s, n), r"^www\.", ""), path, strip_tracking_params(q))

    return _parts(url, key)


def same_site(first: Column, second: Column) -> Column:
    """Whether both URLs are public and have the same host, port and credentials, `www.` aside."""
    a, b = (_parts(x, lambda s, n, p, q: F.regexp_replace(_netloc(s, n), r"^www\.", "")) for x in (first, second))
    return F.coalesce(a == b, F.lit(False))
