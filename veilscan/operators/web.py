"""Pages, hosts and addresses: broker matching, screening, admission, evidence."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.normalize import canonical_url, domain, host
from ..sources.dims import BLOCKED_RANGES, BLOCKED_RANGES_V6, LOGIN_WALLED
from .prefix import address, in_networks

#: Bytes of a page that is read, pages a scan reads.
PAGE_BYTES, PAGE_BUDGET = 524_288, 10


def suffixes(name: Column) -> Column:
    """Every dot-suffix of a host, the host itself first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def broker_match(hosts: DataFrame, catalog: DataFrame, host_column: str = "host", aliases: bool = False, more: tuple = ()) -> DataFrame:
    """``hosts`` (distinct) with the broker of each: an exact domain first, then suffixes, by catalog order; with ``aliases`` other domains count too and catalog order alone decides.

    A suffix match is an equal key once suffixes are exploded. The catalog is a stated dimension."""
    known = catalog.withColumn("domain_key", F.explode(F.array_append("domains", F.col("domain")) if aliases else F.array("domain")))
    found = hosts.select(host_column).distinct().withColumn("suffix", F.explode(suffixes(F.lower(F.col(host_column))))).join(known, F.col("suffix") == F.lower("domain_key"))
    exact = (F.col("suffix") == F.lower(F.col(host_column))).cast("int")
    order = F.struct("position") if aliases else F.struct((1 - exact).alias("inexact"), "position")
    best = found.groupBy(host_column).agg(F.min_by(F.struct("name", "domain", "opt_out_url", *more), order).alias("b"))
    return best.select(host_column, F.col("b.name").alias("broker"), F.col("b.domain").alias("broker_domain"), F.col("b.opt_out_url").alias("opt_out_url"), *[F.col(f"b.{c}").alias(c) for c in more])


def opt_outs(findings: DataFrame, catalog: DataFrame, host_column: str = "host", stated: str = "opt_out_url") -> DataFrame:
    """Findings with ``opt_out`` and ``instructions`` of their broker: a page stated with the finding wins over the catalog's;
    instructions are the catalog's either way. Null where the host is of no broker. Columns keep their names."""
    known = broker_match(findings.select(host_column), catalog, host_column, more=("instructions",)).select(F.col(host_column).alias("__host"), F.col("opt_out_url").alias("__url"), F.col("instructions").alias("__how"))
    both = findings.join(known, F.col(host_column) == F.col("__host"), "left")
    return both.select(*findings.columns, F.coalesce(F.col(stated), "__url").alias("opt_out"), F.col("__how").alias("instructions"))


def best_evidence(findings: DataFrame, key: str = "broker", tier: str = "tier", position: str = "position") -> DataFrame:
    """One finding for each key: documents before snippets, then input order."""
    w = Window.partitionBy(key).orderBy((F.col(tier) != "document").cast("int"), position)
    return findings.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def walled(hosts: Column) -> Column:
    """Whether a host is one of the login-walled sites or below one."""
    return F.arrays_overlap(suffixes(hosts), F.array(*[F.lit(d) for d in LOGIN_WALLED]))


def blocked_range(ip: Column) -> Column:
    """The network that keeps an address from being fetched, judged by the address itself, however it is spelled: a mapped
    IPv4 address as that. ``malformed`` for what is no address; null if it may be fetched."""
    found = lambda digits: F.when(digits.isNull(), F.lit("malformed")).otherwise(in_networks(digits, BLOCKED_RANGES + BLOCKED_RANGES_V6))
    return let(address(ip), found)


def screened(addresses: DataFrame, column: str = "ip") -> DataFrame:
    """``addresses`` with ``cidr`` (the blocked network that holds it, null if none does) and ``blocked``; what is no address is blocked."""
    found = blocked_range(F.col(column))
    return addresses.withColumn("cidr", F.when(found != "malformed", found)).withColumn("blocked", found.isNotNull())


def hosts_blocked(resolved: DataFrame) -> DataFrame:
    """Of (host, addresses): a host is blocked if any address is, or there is none."""
    each = resolved.select("host", F.explode_outer("addresses").alias("ip"))
    return screened(each).groupBy("host").agg(F.bool_or("blocked").alias("blocked"))


#: Kinds of pages that are read.
READ_TYPES = ["text/html", "application/xhtml+xml", "application/pdf"]


def fetch_reason(url: Column, html: Column, content_type: Column | None = None) -> Column:
    """Why a page isn't read; null if it is. A host that is an address (in brackets or not) is screened as one. A content type, where it is known, must be one that is read; parameters after it don't count."""
    kind = F.lower(F.trim(F.substring_index(F.lit("text/html") if content_type is None else F.coalesce(content_type, F.lit("")), ";", 1)))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    h = F.coalesce(host(url), F.lit(""))
    local = h.isin("localhost", "") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".localdomain") | h.endswith(".internal")
    literal = h.contains(":") | h.rlike(r"^\d+(\.\d+)*$")
    return (
        F.when(~scheme.isin("http", "https"), "blocked_protocol")
        .when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "blocked_protocol")
        .when(local | (literal & blocked_range(h).isNotNull()), "ssrf_private_address")
        .when(walled(h), "denylisted_domain")
        .when(html.isNull(), "fetch_error")
        .when(~kind.isin(*READ_TYPES), "unsupported_content_type")
        .when(F.octet_length(html) > PAGE_BYTES, "page_too_large")
    )


def tiered(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Discovery results with their tier: a document if the page was read, else a snippet with the reason; no row is dropped."""
    p = pages.select(canonical_url(pages["url"]).alias("canonical_url"), fetch_reason(pages["url"], pages["html"]).alias("reason")).groupBy("canonical_url").agg(F.min("reason").alias("reason"), F.bool_or(F.col("reason").isNull()).alias("read"))
    both = results.withColumn("canonical_url", canonical_url(results["url"])).join(p, "canonical_url", "left")
    read = F.coalesce(F.col("read"), F.lit(False))
    return both.withColumn("tier", F.when(read, "document").otherwise("snippet")).withColumn("reason", F.when(~read, F.coalesce("reason", F.lit("fetch_error")))).drop("read")


def first_by_url(results: DataFrame, scan: str = "scan_id", order: tuple = ("query_no", "position")) -> DataFrame:
    """The first result of each canonical URL in a scan."""
    key = F.coalesce(canonical_url(F.col("url")), F.col("url"))
    w = Window.partitionBy(scan, key).orderBy(*order)
    return results.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def site(url: Column) -> Column:
    return domain(url)
