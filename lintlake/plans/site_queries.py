"""Registered queries: pages, scripts and assets of crawled sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import urls
from lintlake.operators import bundle as bn
from lintlake.plans import checks as ck
from lintlake.plans.derived import fill, hash_names, hash_names_sql, table
from lintlake.plans.registry import register
from lintlake.plans.templates import render_sql

# What is added to the head of each page, and the assets its site serves.
HEAD = (
    '<script src="/static/app{id}.js"></script><link rel="modulepreload" href="chunks/m{id}.mjs?v=1">'
    '<script src="https://cdn.other.example/x.js"></script><link rel="preload" as="style" href="/s{id}.css">'
    '<script src="../up/u{id}.js"></script><link rel="stylesheet" href="/t.js"><link rel=\'preload\' as=\'script\' href=\'/p{id}.js\'>'
    '<script id="n" type="application/json">{"buildId":"b{id}"}</script><script>  </script>'
    "<script>let k = 'ghp_{h24}';\nlet a = 'AKIA{H16}', b = 'AKIA{H16}X';</script>"
)
# (path, status, body) of the assets of a site; the base folder of its pages does not matter for rooted ones.
ASSETS = [
    ("/static/app{id}.js", 200, 'const a = "sk_live_{h24}";\n\nconst j = "{jwt}";\n//# sourceMappingURL=app{id}.js.map'),
    ("/static/app{id}.js.map", 200, "{}"),
    ("/p{id}.js", 404, 'const a = "ghp_{h24}";'),
    ("/_next/static/b{id}/_buildManifest.js", 200, 'self.M={"/a":["static/chunks/a{id}.js"],"/b":["static/chunks/b{id}.js"]}'),
    ("/_next/static/chunks/a{id}.js", 200, 'x("re_{h20}"); y("re_{h20}")\n//# sourceMappingURL=data:application/json,x'),
    ("/_next/static/chunks/b{id}.js", 200, "nothing here\n//# sourceMappingURL=gone.map"),
]
CLAIMS = '{"iss":"x","ref":"proj{id}","role":"service_role"}'
ANON_CLAIMS = '{"iss":"x","ref":"proj{id}","role":"anon"}'
JWT_HEAD, JWT_TAIL = "eyJhbGciOiJIUzI1NiJ9", "c2lnbmF0dXJl"


def _token(page_id):
    claims = F.when(page_id % 3 == 0, F.lit(ANON_CLAIMS)).otherwise(F.lit(CLAIMS))
    claims = F.replace(claims, F.lit("{id}"), page_id.cast("string"))
    body = F.rtrim(F.translate(F.base64(F.encode(claims, "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    return F.concat(F.lit(JWT_HEAD + "."), body, F.lit("." + JWT_TAIL))


def _token_sql(page_id: str) -> str:
    claims = f"CASE WHEN {page_id} % 3 = 0 THEN {ck.q(ANON_CLAIMS)} ELSE {ck.q(CLAIMS)} END"
    encoded = f"rtrim(replace(replace(to_base64(encode(replace({claims}, '{{id}}', CAST({page_id} AS VARCHAR)))), '+', '-'), '/', '_'), '=')"
    return f"'{JWT_HEAD}.' || {encoded} || '.{JWT_TAIL}'"


def derived_pages(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    head = F.concat(F.lit("<head>"), fill(F.lit(HEAD), hash_names(F.col("page_id"))))
    return pages.select("page_id", "url", F.replace("html", F.lit("<head>"), head).alias("html"))


def derived_assets(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    names = {**hash_names(F.col("page_id")), "jwt": _token(F.col("page_id"))}
    each = pages.select("page_id", "url", F.explode(F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(s).alias("status"), F.lit(b).alias("body")) for p, s, b in ASSETS
    ])).alias("a"))
    return each.select(
        F.concat(urls.url_origin(F.col("url")), fill(F.col("a.path"), names)).alias("url"),
        F.col("a.status").alias("status"), fill(F.col("a.body"), names).alias("body"))


_names = hash_names_sql("page_id")
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
FOLDER = "regexp_extract(url, '^(https?://[^?#]*/)', 1)"
PARENT = "regexp_replace(regexp_extract(url, '^(https?://[^?#]*/)', 1), '(^https?://[^/]+)(?:(.*)/[^/]+/|/)$', '\\1\\2/')"
PAGE_PATH = "CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END"
PAGES_SQL = f"SELECT page_id, url, replace(html, '<head>', '<head>' || {render_sql(HEAD, _names)}) AS html FROM pages"


@register("load_pages", "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def load_pages(spark, sf_dir):
    return bn.load_pages(table(spark, sf_dir, "pages")).select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"))


INLINE_SQL = f"""SELECT page_id, url, list_filter(list_transform(regexp_extract_all(regexp_replace(html,
    '(?is)<script\\b[^>]*\\bsrc=[^>]*>', '<gone>', 'g'), '(?is)<script\\b[^>]*>.*?</script>'), lambda s: regexp_extract(s, '(?is)^<script\\b[^>]*>(.*)</script>$', 1)),
    lambda s: {ck.trim_sql('s')} <> '') AS bodies FROM ({PAGES_SQL})"""


@register("inline_scripts", f"SELECT page_id, CAST(generate_subscripts(bodies, 1) AS INTEGER) AS seq, unnest(bodies) AS body FROM ({INLINE_SQL})")
def inline_scripts(spark, sf_dir):
    return bn.inline_scripts(derived_pages(spark, sf_dir)).select("page_id", "seq", "body")


REFS_SQL = f"""SELECT page_id, {ORIGIN} || '/static/app' || page_id || '.js' AS url FROM pages
    UNION SELECT page_id, {FOLDER} || 'chunks/m' || page_id || '.mjs?v=1' FROM pages
    UNION SELECT page_id, {PARENT} || 'up/u' || page_id || '.js' FROM pages
    UNION SELECT page_id, {ORIGIN} || '/p' || page_id || '.js' FROM pages"""


@register("script_refs", REFS_SQL + " UNION SELECT page_id, 'https://cdn.other.example/x.js' FROM pages")
def script_refs(spark, sf_dir):
    return bn.script_refs(derived_pages(spark, sf_dir)).select("page_id", "url")


@register("same_origin_refs", REFS_SQL)
def same_origin_refs(spark, sf_dir):
    return bn.same_origin_refs(bn.script_refs(derived_pages(spark, sf_dir))).select("page_id", "url")


# A reference is tried as found, without its slash, from this folder, from the one above, and as a query and a fragment of the page.
@register("resolve_url", f"""WITH found AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
    based AS (SELECT *, {ORIGIN} AS origin, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS page_path FROM found),
    foldered AS (SELECT *, coalesce(nullif(page_path, ''), '/') AS whole, regexp_replace(coalesce(nullif(page_path, ''), '/'), '[^/]*$', '') AS folder
      FROM based),
    tried AS (SELECT *, ltrim(href, '/') AS name, regexp_replace(folder, '[^/]+/$', '') AS above FROM foldered)
    SELECT page_id, ref, url FROM (
      SELECT page_id, href AS ref, CASE WHEN href LIKE '/%' THEN origin || href ELSE href END AS url FROM tried WHERE href LIKE '/%' OR href LIKE 'http%/%'
      UNION SELECT page_id, name, origin || folder || name FROM tried WHERE href LIKE '/%'
      UNION SELECT page_id, './' || name, origin || folder || name FROM tried WHERE href LIKE '/%'
      UNION SELECT page_id, '../' || name, origin || above || name FROM tried WHERE href LIKE '/%'
      UNION SELECT page_id, '?q=' || name, origin || whole || '?q=' || name FROM tried WHERE href LIKE '/%'
      UNION SELECT page_id, '#' || name, origin || whole || '#' || name FROM tried WHERE href LIKE '/%')""")
def resolve_url(spark, sf_dir):
    refs = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    name = F.regexp_replace("href", "^/+", "")
    forms = F.when(F.col("href").startswith("/"), F.array(
        F.col("href"), name, *[F.concat(F.lit(p), name) for p in ("./", "../", "?q=", "#")])).otherwise(F.array("href"))
    tried = refs.where("href like '/%' or href like 'http%/%'").select("page_id", "url", F.explode(forms).alias("ref")).distinct()
    return tried.select("page_id", "ref", urls.resolve_url(F.col("url"), F.col("ref")).alias("url"))


CHUNKS_SQL = f"""SELECT page_id, {ORIGIN} || '/_next/static/chunks/a' || page_id || '.js' AS url FROM pages
    UNION SELECT page_id, {ORIGIN} || '/_next/static/chunks/b' || page_id || '.js' FROM pages"""


@register("manifest_chunks", CHUNKS_SQL)
def manifest_chunks(spark, sf_dir):
    return bn.manifest_chunks(derived_pages(spark, sf_dir), derived_assets(spark, sf_dir)).select("page_id", "url")


@register("site_assets", f"""SELECT page_id, {ORIGIN} || '/static/app' || page_id || '.js' AS url, 0 AS hop FROM pages
    UNION ALL SELECT page_id, {ORIGIN} || '/_next/static/b' || page_id || '/_buildManifest.js', 1 FROM pages
    UNION ALL SELECT page_id, url, 2 FROM ({CHUNKS_SQL})""")
def site_assets(spark, sf_dir):
    return bn.site_assets(derived_pages(spark, sf_dir), derived_assets(spark, sf_dir)).select("page_id", "url", "hop")


# Where each planted credential must show up, written out per page.
INLINE_LABEL = f"{PAGE_PATH} || ' (inline script ' || pos || ')'"
SHOWN_SQL = f"""WITH inline AS (SELECT page_id, url, list_position(bodies, list_filter(bodies, lambda b: contains(b, 'let k = '))[1]) AS pos FROM ({INLINE_SQL})),
    found AS (SELECT url, 'bundle.github_pat' AS rule, {INLINE_LABEL} AS file, 1 AS line, 'ghp_' || substr({_names['h24']}, 1, 4) AS shown, 1 AS n FROM inline
      UNION ALL SELECT url, 'bundle.aws_key', {INLINE_LABEL}, 2, 'AKIA' || substr({_names['H16']}, 1, 4), 2 FROM inline
      UNION ALL SELECT url, 'bundle.stripe_live', '/static/app' || page_id || '.js', 1, 'sk_live_', 1 FROM pages
      UNION ALL SELECT url, 'bundle.resend_key', '/_next/static/chunks/a' || page_id || '.js', 1, 're_' || substr({_names['h20']}, 1, 5), 2 FROM pages)"""


def site_facts(spark, sf_dir) -> DataFrame:
    return bn.site_facts(derived_pages(spark, sf_dir), derived_assets(spark, sf_dir))


@register("scan_bundle", f"""{SHOWN_SQL} SELECT url AS repo_id, rule, file, CAST(line AS INTEGER) AS line,
    file || ':' || line || ' ' || shown || '…[redacted]' AS evidence, CAST(n AS BIGINT) AS n FROM found""")
def scan_bundle(spark, sf_dir):
    return bn.bundle_credentials(site_facts(spark, sf_dir)).groupBy("repo_id", "rule", "file", "line", "evidence").agg(F.count("*").alias("n"))


ROLE_SQL = """SELECT url AS repo_id, 'bundle.supabase_service_role' AS rule, '/static/app' || page_id || '.js' AS file, 3 AS line,
    '/static/app' || page_id || '.js:3 JWT with role "service_role" for project proj' || page_id AS evidence FROM pages WHERE page_id % 3 <> 0"""


@register("bundle_service_role", ROLE_SQL)
def bundle_service_role(spark, sf_dir):
    return bn.bundle_service_role(site_facts(spark, sf_dir)).select("repo_id", "rule", "file", "line", "evidence")


MAPS_SQL = """SELECT url AS repo_id, '/static/app' || page_id || '.js' AS file, '/static/app' || page_id || '.js.map' AS evidence,
    'Production source maps are publicly downloadable (1 found)' AS title, 70 - 2 AS confidence_score FROM pages"""


@register("bundle_source_maps", MAPS_SQL)
def bundle_source_maps(spark, sf_dir):
    return bn.bundle_source_maps(site_facts(spark, sf_dir), derived_assets(spark, sf_dir)).select("repo_id", "file", "evidence", "title", "confidence_score")


@register("scan_site", f"""{SHOWN_SQL} SELECT repo_id, rule, CAST(sum(n) AS BIGINT) AS n FROM (SELECT url AS repo_id, rule, n FROM found
    UNION ALL SELECT repo_id, rule, 1 FROM ({ROLE_SQL}) UNION ALL SELECT repo_id, 'bundle.source_maps_public', 1 FROM ({MAPS_SQL})) GROUP BY ALL""")
def scan_site(spark, sf_dir):
    findings = bn.scan_site(derived_pages(spark, sf_dir), derived_assets(spark, sf_dir))
    return findings.groupBy("repo_id", "rule").agg(F.count("*").alias("n"))


@register("decode_jwt_claims", f"""SELECT page_id, {_token_sql('page_id')} AS token, CASE WHEN page_id % 3 = 0 THEN 'anon' ELSE 'service_role' END AS role,
    'proj' || page_id AS ref FROM pages""")
def decode_jwt_claims(spark, sf_dir):
    tokens = table(spark, sf_dir, "pages").select("page_id", _token(F.col("page_id")).alias("token"))
    return tokens.withColumn("claims", urls.decode_jwt_claims(F.col("token"))).select(
        "page_id", "token", F.col("claims.role").alias("role"), F.col("claims.ref").alias("ref"))
