"""What a site offers besides pages, told from the responses to fixed paths.

``responses``: base, key, status, content_type, body, headers map<string,string>; one row for each path that answered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The paths by key, and what marks a framework's home page, in order of preference.
PATHS = {
    "llms_full_1": "/llms-full.txt",
    "llms_full_2": "/.well-known/llms-full.txt",
    "llms_1": "/llms.txt",
    "llms_2": "/.well-known/llms.txt",
    "sitemap_1": "/sitemap.xml",
    "sitemap_2": "/sitemap_index.xml",
    "openapi_1": "/openapi.json",
    "openapi_2": "/swagger.json",
    "openapi_3": "/api-docs",
    "openapi_4": "/.well-known/openapi.yaml",
    "homepage": "/",
}
FRAMEWORKS = (
    ("docusaurus", '<meta name="generator" content="Docusaurus'),
    ("docusaurus", '<div id="__docusaurus">'),
    ("gitbook", '<meta name="generator" content="GitBook"'),
    ("readthedocs", "window.READTHEDOCS_DATA"),
    ("mkdocs", '<meta name="generator" content="mkdocs-'),
)


def requests(bases: DataFrame) -> DataFrame:
    """(base, key, url) of the paths to ask for."""
    paths = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(p).alias("path")) for k, p in PATHS.items()))
    return bases.select("base", F.explode(paths).alias("p")).select("base", "p.key", F.concat("base", "p.path").alias("url"))


def detect(responses: DataFrame) -> DataFrame:
    """(base, type, url, framework, body) of each base that has something: llms text, then sitemap, API specification, framework."""
    kind, low = F.regexp_extract("key", "^([a-z]+)", 1), F.lower(F.coalesce("content_type", F.lit("")))
    framework = F.when(F.element_at("headers", "X-ReadTheDocs-Project").isNotNull(), "readthedocs")
    for name, mark in FRAMEWORKS:
        framework = framework.when(F.col("body").contains(mark), name)
    fits = (
        F.when(kind == "llms", low.contains("text/plain") | low.contains("markdown"))
        .when(kind == "sitemap", F.col("body").contains("<urlset") | F.col("body").contains("<sitemapindex"))
        .when(kind == "openapi", (low.contains("json") | low.contains("yaml")) & (F.col("body").contains('"openapi"') | F.col("body").contains('"swagger"') | F.col("body").contains("openapi:")))
        .otherwise(framework.isNotNull())
    )
    rank = F.array_position(F.array(*map(F.lit, PATHS)), F.col("key"))
    types = F.when(kind == "llms", "llms_txt").when(kind == "homepage", "framework").otherwise(kind)
    path = F.element_at(F.create_map(*(F.lit(x) for pair in PATHS.items() for x in pair)), F.col("key"))
    found = responses.where((F.col("status") == 200) & (rank > 0)).where(fits)
    best = F.min_by(
        F.struct(types.alias("type"), F.concat("base", path).alias("url"), F.when(kind == "homepage", framework).alias("framework"), F.when(kind != "homepage", F.col("body")).alias("body")), rank
    )
    return found.groupBy("base").agg(best.alias("d")).select("base", "d.*")
