"""Normal forms, masks, keys and query plans as column functions."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from ..sources.dims import TRACKING

_DOTS = "••••"


def email(x: Column) -> Column:
    return F.lower(F.trim(x))


def is_email_shaped(query: Column) -> Column:
    """Whether a query, without quotes around it, is one address: it then goes to the breach source."""
    x = F.trim(F.regexp_replace(query, '^"|"$', ""))
    return F.coalesce(x.rlike(r"^[^\s@]+@[^\s@]+[.][^\s@]+$"), F.lit(False))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def identifier(kind: Column, value: Column) -> Column:
    v = F.trim(value)
    return F.when(kind == "EMAIL", F.lower(v)).when(kind == "PHONE", F.regexp_replace(v, r"[^\d+]", "")).when(kind == "USERNAME", F.regexp_replace(F.lower(v), "^@", "")).otherwise(F.regexp_replace(F.lower(v), r"\s+", " "))


def entity(kind: Column, value: Column, phone: Column) -> Column:
    """An entity's normal form by type; ``phone`` is its international form or null."""
    v = F.trim(value)
    return F.when(kind == "EMAIL", F.lower(v)).when(kind == "PHONE", F.coalesce(phone, v)).when(kind == "PAN", F.upper(v)).when(kind == "AADHAAR", digits(value)).otherwise(v)


def mask_email(x: Column) -> Column:
    local, domain = F.substring_index(email(x), "@", 1), F.substring_index(email(x), "@", -1)
    stars = F.repeat(F.lit("*"), F.least(F.lit(3), F.length(local) - 1))
    return F.when(F.size(F.split(x, "@")) != 2, F.lit("••••@••••.com")).when(F.length(local) <= 1, F.concat(F.lit("*@"), domain)).otherwise(F.concat(F.left(local, F.lit(1)), stars, F.lit("@"), domain))


def mask_phone(x: Column) -> Column:
    clean = F.regexp_replace(x, r"\s+", "")
    prefix = F.when(clean.startswith("+91"), F.lit("+91 ")).otherwise(F.concat(F.left(clean, F.lit(3)), F.lit(" ")))
    return F.when(F.length(clean) <= 4, F.lit(_DOTS)).otherwise(F.concat(prefix, F.lit(_DOTS + " "), F.right(clean, F.lit(4))))


def mask_aadhaar(x: Column) -> Column:
    return F.when(F.length(digits(x)) == 12, F.concat(F.lit(f"{_DOTS} {_DOTS} "), F.right(digits(x), F.lit(4)))).otherwise(F.lit(f"{_DOTS} {_DOTS} {_DOTS}"))


def mask_pan(x: Column) -> Column:
    clean = F.upper(F.trim(x))
    return F.when(F.length(clean) == 10, F.concat(F.left(clean, F.lit(3)), F.lit("•" * 5), F.right(clean, F.lit(2)))).otherwise(F.lit("•" * 10))


def mask(kind: Column, value: Column) -> Column:
    """A span's mask by type."""
    return F.when(kind == "EMAIL", mask_email(value)).when(kind == "PHONE", mask_phone(value)).when(kind == "AADHAAR", mask_aadhaar(value)).when(kind == "PAN", mask_pan(value)).otherwise(F.lit(_DOTS))


def mask_identifier(kind: Column, value: Column) -> Column:
    """The short masks that an interface shows."""
    local, domain = F.get(F.split(value, "@"), 0), F.get(F.split(value, "@"), 1)
    mail = F.when((F.coalesce(local, F.lit("")) == "") | (F.coalesce(domain, F.lit("")) == ""), F.lit("***")).otherwise(F.concat(F.left(local, F.lit(1)), F.lit("***@"), domain))
    phone = F.concat(F.lit("+"), F.left(digits(value), F.lit(2)), F.lit(f" {_DOTS} "), F.right(digits(value), F.lit(4)))
    other = F.when(F.length(value) <= 4, F.lit(_DOTS)).otherwise(F.concat(F.left(value, F.lit(1)), F.lit(_DOTS), F.right(value, F.lit(2))))
    return F.when(kind == "EMAIL", mail).when(kind == "PHONE", phone).otherwise(other)


def redacted(text: Column, found: Column) -> Column:
    """A text with each span (by start, without overlap) in its mask's place: what stands before each span with its mask, put together once."""

    def joined(spans: Column) -> Column:
        until = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, until(i) + 1, s["start"] - until(i)), mask(s["type"], s["raw"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, until(F.size(spans)) + 1, F.length(text)))

    return let(found, joined)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    """Host in lower case without www; empty if there is none."""
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def clean_domain(x: Column) -> Column:
    """A domain out of loose text: no scheme, www, path or port."""
    return F.substring_index(F.substring_index(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "^https?://", ""), r"^www\.", ""), "/", 1), ":", 1)


def is_pdf(url: Column) -> Column:
    return url.rlike(r"(?i)[.]pdf([?#]|$)")


def canonical_url(url: Column) -> Column:
    """https, plain host, no fragment, port of the scheme, tracking parameters or trailing slash; parameters by key. Null unless http(s)."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(F.try_parse_url(u, F.lit("AUTHORITY")), ":([0-9]+)$", 1)
    own = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    params = F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    placed = F.array_sort(F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(placed, lambda s: s["p"]), "&")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")
    made = F.concat(F.lit("https://"), domain(u), F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (domain(u) != ""), made)


def fingerprint(identity: Column, source: Column, kind: Column, value: Column) -> Column:
    """The key of a finding over scans: hash of identity, source, type and normal entity."""
    normal = F.coalesce(canonical_url(value), F.lower(F.trim(value)))
    return F.sha2(F.concat_ws("\0", identity.cast("string"), F.lower(source), F.upper(kind), normal), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash in hex; the pads are made on the driver."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = [F.lit(bytearray(b ^ x for b in key)) for x in (0x5C, 0x36)]
    return F.sha2(F.concat(pads[0], F.unhex(F.sha2(F.concat(pads[1], F.encode(message, "UTF-8")), 256))), 256)


def query_value(x: Column) -> Column:
    """A value for a search: operator characters become spaces, leading - and ~ go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9@._+\s-]", " "), r"(^|\s)[-~]+(?=\S)", "$1"), r"\s+", " "))


def query_plan(mail: Column, username: Column, name: Column, org: Column, most: int = 6) -> Column:
    """Distinct searches in order: the exact identifiers first, then compounds."""
    m, u, n, o = (F.coalesce(query_value(x), F.lit("")) for x in (mail, username, name, org))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    plans = F.array(
        F.when(m != "", quoted(m)),
        F.when(u != "", quoted(u)),
        F.when((n != "") & (m != ""), F.concat(quoted(n), F.lit(" "), quoted(m))),
        F.when(m != "", F.concat(quoted(m), F.lit(" filetype:pdf"))),
        F.when((n != "") & (o != ""), F.concat(quoted(n), F.lit(" "), quoted(o))),
    )
    return F.slice(F.array_distinct(F.array_compact(plans)), 1, most)
