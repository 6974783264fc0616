"""Crawls over stored pages, and sites as graphs. Nothing is fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import deterministic_uuid
from weftgraph.functions.patterns import url_allowed
from weftgraph.functions.text import normalize_url, page_facts, page_links
from weftgraph.session import Scratch


def crawl(pages: DataFrame, seeds: Sequence[str], *, depth: int = 2, max_pages: int | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``url, depth``: stored pages that the seeds reach over at most so many links, each at its least depth.

    Breadth first: a round joins the frontier with the links of allowed pages, and a page is visited once. ``max_pages``
    keeps the nearest pages (ties by address); without it all count. Rounds are written, so plans do not grow.
    """
    scratch = Scratch(pages.sparkSession, "crawl")
    allowed = scratch.write(pages.select(normalize_url(F.col(url_col)).alias("url")).where(url_allowed(F.col("url"), include, exclude)).distinct(), "allowed")
    links = scratch.write(page_links(pages, url_col, html_col), "links")
    start = pages.sparkSession.createDataFrame([(s,) for s in seeds], "url string").select(normalize_url(F.col("url")).alias("url")).distinct()
    seen = scratch.write(start.join(allowed, "url", "left_semi").withColumn("depth", F.lit(0)), "seen")
    front = seen
    for d in range(1, depth + 1):
        found = front.join(links, front["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        front = scratch.write(found.join(allowed, "url", "left_semi").join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def site_graph(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, label, url, title, description``) and edges (``src, dst, type``) of stored pages.

    A Website per host with HAS_PAGE to its pages, and LINKS_TO between pages of one site that link to each other; a
    page that links to itself does not. Pages with one normalised address count once, with their greatest texts.
    """
    facts = page_facts(pages, url_col, html_col).groupBy("url").agg(F.max("title").alias("title"), F.max("description").alias("description"))
    site = F.regexp_extract("url", r"^(\w+://[^/]+)", 1)
    page = facts.where(F.length(site) > 0).select(deterministic_uuid(F.concat(F.lit("page:"), "url")).alias("id"), "url", "title", "description", site.alias("site"))
    site_id = deterministic_uuid(F.concat(F.lit("site:"), F.col("site")))
    sites = page.groupBy("site").agg(F.count(F.lit(1)).alias("_n")).select(site_id.alias("id"), F.lit("Website").alias("label"), F.col("site").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"))
    nodes = page.select("id", F.lit("WebPage").alias("label"), "url", "title", "description").unionByName(sites)
    host = lambda c: F.regexp_extract(c, r"^(\w+://[^/]+)", 1)
    links = page_links(pages, url_col, html_col).where(host("src") == host("dst"))
    of = lambda c: deterministic_uuid(F.concat(F.lit("page:"), F.col(c)))
    edges = page.select(site_id.alias("src"), F.col("id").alias("dst"), F.lit("HAS_PAGE").alias("type")).unionByName(links.select(of("src").alias("src"), of("dst").alias("dst"), F.lit("LINKS_TO").alias("type")))
    return nodes, edges
