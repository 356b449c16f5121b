"""Queries over pages: text, URLs, brokers, screening, evidence."""

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..operators import monitor, web
from ..sources.dims import BLOCKED_RANGES, BROKERS, brokers
from .registry import query, table

_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
_DOMAIN = f"regexp_replace({_HOST}, '^www\\.', '')"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_KEPT = f"list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT regexp_matches(lower(p), '^(fbclid|gclid|dclid|msclkid|twclid|igshid|mc_cid|mc_eid|yclid|vero_id|wickedid|hsa_[a-z]+|_ga|_gl)(=|$)'))"
_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"
CANONICAL = f"CASE WHEN regexp_matches(lower(url), '^https?://') THEN 'https://' || {_DOMAIN} || {_PATH} || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string(list_sort({_KEPT}), '&') ELSE '' END END"
_CATALOG = "(VALUES " + ", ".join(f"('{n}', '{d}', '{o}', {a!r}::VARCHAR[], {i})" for i, (n, d, o, a) in enumerate(BROKERS)) + ") AS b(name, domain, opt_out_url, domains, position)"
_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '(?i)&#39;', '''', 'g'), '(?i)&amp;', '&', 'g'))"""
_TEXT = f"trim(regexp_replace({_TEXT}, '[\\s ]+', ' ', 'g'))"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("SELECT sha256(html) AS sha, count(*) AS copies, min(page_id) AS first_page FROM pages GROUP BY 1")
def page_content_hash_dups(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(F.sha2("html", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("page_id").alias("first_page"))


@query(f"SELECT page_id, {_DOMAIN} AS domain, regexp_matches(url, '(?i)[.]pdf([?#]|$)') AS is_pdf FROM pages")
def url_domain(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", N.domain(F.col("url")).alias("domain"), N.is_pdf(F.col("url")).alias("is_pdf"))


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", N.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT min(page_id) AS page_id, {CANONICAL} AS canonical FROM pages GROUP BY 2")
def url_canonical_dedupe(spark, sf_dir):
    r = pages(spark, sf_dir).select(F.lit(1).alias("scan_id"), "page_id", "url", F.lit(0).alias("query_no"), F.col("page_id").alias("position"))
    # one scan holds all pages here, so the window is by URL
    return web.first_by_url(r).select("page_id", N.canonical_url(F.col("url")).alias("canonical"))


@query(f"""WITH h AS (SELECT DISTINCT {_DOMAIN} AS host FROM pages), m AS (SELECT host, name, domain, opt_out_url, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN host = domain THEN 0 ELSE 1 END, position) AS n FROM h, {_CATALOG} WHERE host = domain OR ends_with(host, '.' || domain))
SELECT host, name AS broker, domain AS broker_domain, opt_out_url FROM m WHERE n = 1""")
def broker_suffix_match(spark, sf_dir):
    return web.broker_match(pages(spark, sf_dir).select(N.domain(F.col("url")).alias("host")), brokers(spark))


@query(f"""WITH h AS (SELECT DISTINCT {_DOMAIN} AS host FROM pages), k AS (SELECT *, unnest(list_append(domains, domain)) AS d FROM {_CATALOG}),
m AS (SELECT host, name, domain, opt_out_url, row_number() OVER (PARTITION BY host ORDER BY position) AS n FROM h, k WHERE host = d OR ends_with(host, '.' || d))
SELECT host, name AS broker, domain AS broker_domain, opt_out_url FROM m WHERE n = 1""")
def broker_alias_match(spark, sf_dir):
    return web.broker_match(pages(spark, sf_dir).select(N.domain(F.col("url")).alias("host")), brokers(spark), aliases=True)


@query(f"""WITH p AS (SELECT page_id, {_DOMAIN} AS host, CASE WHEN page_id % 3 = 0 THEN 'document' ELSE 'snippet' END AS tier FROM pages),
m AS (SELECT page_id, tier, name, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN host = domain THEN 0 ELSE 1 END, position) AS n FROM p, {_CATALOG} WHERE host = domain OR ends_with(host, '.' || domain)),
r AS (SELECT name AS broker, page_id, tier, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN tier = 'document' THEN 0 ELSE 1 END, page_id) AS k FROM m WHERE n = 1)
SELECT broker, page_id, tier FROM r WHERE k = 1""")
def broker_best_evidence(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", N.domain(F.col("url")).alias("host"), F.when(F.col("page_id") % 3 == 0, "document").otherwise("snippet").alias("tier"))
    matched = p.join(web.broker_match(p, brokers(spark)), "host").select("broker", "page_id", "tier", F.col("page_id").alias("position"))
    return web.best_evidence(matched).select("broker", "page_id", "tier")


@query(f"""WITH p AS (SELECT page_id, {_DOMAIN} AS host FROM pages), m AS (SELECT page_id, opt_out_url, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN host = domain THEN 0 ELSE 1 END, position) AS n FROM p, {_CATALOG} WHERE host = domain OR ends_with(host, '.' || domain))
SELECT p.page_id, coalesce(CASE WHEN p.page_id % 5 = 0 THEN 'https://own.example/out' END, opt_out_url) AS opt_out FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1""")
def broker_optout(spark, sf_dir):
    """An opt-out page stated with the finding wins over the catalog's."""
    p = pages(spark, sf_dir).select("page_id", N.domain(F.col("url")).alias("host"), F.when(F.col("page_id") % 5 == 0, F.lit("https://own.example/out")).alias("own"))
    return p.join(web.broker_match(p, brokers(spark)), "host", "left").select("page_id", F.coalesce("own", "opt_out_url").alias("opt_out"))


@query(f"""WITH p AS (SELECT page_id, {_DOMAIN} AS host FROM pages), m AS (SELECT page_id, name, opt_out_url, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN host = domain THEN 0 ELSE 1 END, position) AS n FROM p, {_CATALOG} WHERE host = domain OR ends_with(host, '.' || domain))
SELECT p.page_id, a.action, CASE WHEN a.action = 'OPT_OUT_BROKER' THEN coalesce(CASE WHEN p.page_id % 5 = 0 THEN 'https://own.example/out' END, opt_out_url) END AS opt_out_url, CASE WHEN a.action = 'OPT_OUT_BROKER' THEN 'Ask ' || name END AS instructions
FROM p JOIN m ON p.page_id = m.page_id AND n = 1, (VALUES ('VERIFY_BEFORE_ACTION'), ('OPT_OUT_BROKER')) a(action)""")
def broker_tasks(spark, sf_dir):
    """What is to be done about pages of brokers, with the page to opt out at and how."""
    from ..functions import rules

    known = brokers(spark).withColumn("instructions", F.concat(F.lit("Ask "), "name"))
    p = pages(spark, sf_dir).select("page_id", N.domain(F.col("url")).alias("host"), F.when(F.col("page_id") % 5 == 0, F.lit("https://own.example/out")).alias("opt_out_url"))
    found = web.opt_outs(p, known).filter("instructions is not null")
    kind, none = F.lit("DATA_BROKER_LISTING"), F.array().cast("array<string>")
    codes = rules.actions(kind, none, F.lit("POTENTIAL"), none, F.col("opt_out"))
    return found.select("page_id", F.explode(rules.tasks(codes, F.col("opt_out"), F.col("instructions"))).alias("t")).select("page_id", "t.*")


@query(f"""SELECT page_id, regexp_matches({_HOST.replace('url', 'u')}, '(^|\\.)(linkedin|facebook|instagram|twitter|x)\\.com$') AS walled FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://in.linkedin.com/p' WHEN 1 THEN 'https://x.com/a' WHEN 2 THEN 'https://notx.com/' ELSE url END AS u FROM pages)""")
def host_denylist(spark, sf_dir):
    k = F.col("page_id") % 4
    u = F.when(k == 0, "https://in.linkedin.com/p").when(k == 1, "https://x.com/a").when(k == 2, "https://notx.com/").otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", web.walled(N.host(u)).alias("walled"))


_IP = r"(?:^|[^0-9.])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?:$|[^0-9.])"
_RANGES = []
for _c in BLOCKED_RANGES:
    _net, _bits = _c.split("/")
    _lo = sum(int(x) << 8 * (3 - i) for i, x in enumerate(_net.split(".")))
    _RANGES.append(f"('{_c}', {_lo}, {_lo + (1 << 32 - int(_bits)) - 1})")


@query(f"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_IP}', 1)) AS ip FROM documents UNION SELECT DISTINCT '10.' || (o_orderkey % 256) || '.' || (o_custkey % 300) || '.7' FROM orders),
s AS (SELECT ip, list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)) AS p FROM a), n AS (SELECT ip, CASE WHEN list_max(p) <= 255 THEN p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] END AS v FROM s)
SELECT ip, cidr, cidr IS NOT NULL OR v IS NULL AS blocked FROM n LEFT JOIN (VALUES {', '.join(_RANGES)}) AS r(cidr, lo, hi) ON v BETWEEN lo AND hi""")
def cidr_block(spark, sf_dir):
    from_text = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(1))).alias("ip"))
    made = table(spark, sf_dir, "orders").select(F.expr("concat('10.', o_orderkey % 256, '.', o_custkey % 300, '.7')").alias("ip"))
    return web.screened(from_text.union(made).distinct())


#: URLs to screen, and why they aren't read: scheme, credentials, local names, addresses in every spelling, walled sites.
_ADMIT = {
    "ftp://a.example/x": "blocked_protocol", "http://u:p@a.example/x": "blocked_protocol", "http://localhost/x": "ssrf_private_address", "http://db.localdomain/x": "ssrf_private_address",
    "http://a.internal/": "ssrf_private_address", "http://127.0.0.1/x": "ssrf_private_address", "http://169.254.169.254/latest": "ssrf_private_address", "http://[::1]/": "ssrf_private_address",
    "http://[::ffff:10.0.0.1]/x": "ssrf_private_address", "http://[fd00::1]:8080/x": "ssrf_private_address", "http://999.1.1.1/": "ssrf_private_address", "https://in.linkedin.com/p": "denylisted_domain",
    "http://8.8.8.8/x": None, "http://[2001:4860::8888]/x": None, "http://[::ffff:8.8.8.8]/x": None,
}
_ADMIT_LIST = ", ".join(f"({i}, '{r}')" if r else f"({i}, NULL)" for i, r in enumerate(_ADMIT.values()))


@query(f"""SELECT page_id, coalesce(r.reason, CASE WHEN octet_length(encode(html)) > 524288 THEN 'page_too_large' END) AS reason FROM pages LEFT JOIN (VALUES {_ADMIT_LIST}) AS r(i, reason) ON page_id % {len(_ADMIT) + 5} = i""")
def fetch_admission(spark, sf_dir):
    """Pages under their own URLs, and under ones that must not be read or may be."""
    own = F.get(F.array(*[F.lit(u) for u in _ADMIT]), (F.col("page_id") % (len(_ADMIT) + 5)).cast("int"))
    return pages(spark, sf_dir).select("page_id", web.fetch_reason(F.coalesce(own, F.col("url")), F.col("html")).alias("reason"))


@query(f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://gone.example/' || page_id ELSE url END AS url FROM pages), p AS (SELECT DISTINCT {CANONICAL} AS c FROM pages)
SELECT r.page_id, CASE WHEN p.c IS NULL THEN 'snippet' ELSE 'document' END AS tier, CASE WHEN p.c IS NULL THEN 'fetch_error' END AS reason FROM (SELECT page_id, {CANONICAL} AS k FROM r) r LEFT JOIN p ON r.k = p.c""")
def evidence_tiering(spark, sf_dir):
    p = pages(spark, sf_dir)
    results = p.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("https://gone.example/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"))
    return web.tiered(results, p).select("page_id", "tier", "reason")


@query("""SELECT scan, page_id FROM (SELECT page_id % 13 AS scan, page_id, row_number() OVER (PARTITION BY page_id % 13 ORDER BY page_id) AS n FROM pages) WHERE n <= 10""")
def page_budget_top10(spark, sf_dir):
    return monitor.newest(pages(spark, sf_dir).select((F.col("page_id") % 13).alias("scan"), "page_id"), ["scan"], ["page_id"], web.PAGE_BUDGET)


@query(f"""SELECT 'search' AS query, {CANONICAL} AS canonical, url AS title, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS INTEGER) AS position FROM pages""")
def search_results_flat(spark, sf_dir):
    """Pages recorded as search answers of ten results, read back."""
    from ..sources.records import search_rows

    p = pages(spark, sf_dir).withColumn("g", F.floor(F.col("page_id") / 10))
    result = F.struct("page_id", F.struct("url").alias("r"))
    answers = p.groupBy("g").agg(F.array_sort(F.collect_list(result)).alias("rs"))
    search = F.struct(F.lit("search").alias("query"), F.transform("rs", lambda x: x["r"]).alias("results"))
    rows = search_rows(answers.select(F.to_json(F.struct(F.array(search).alias("searches"))).alias("json")))
    return rows.select("query", N.canonical_url(F.col("url")).alias("canonical"), "title", "position")
