"""Line dedup by site-relative frequency.

A line is boilerplate on a site if the share of the site's pages that contain it
exceeds ``MAX_RATIO``. Lines are counted once a page as (site, line hash) with a
map-side combine, so neither a large site nor a line on every page meets in one
task; a site's page total joins only lines that enough pages share. A site can
have no more boilerplate lines than its mean lines a page over ``MAX_RATIO``, so
they travel as one short array a site: broadcast while the arrays are few, else
dealt with a salt so that a site with a third of all pages is spread.

The site of a page is the host of its URL (``host_of``); of documents, which have no
URL, it is their source. A ratio of 0.05 lies well below what stands on every tenth
page and more, and well above what a few in a hundred share: the latter stays.

Defined results: blank lines are never counted or dropped; a line is compared as
it stands, however long; null text stays null, empty text stays empty, a page may become empty
and is kept; null is a site of its own; repeated rows count as pages; sites with
fewer than ``MIN_SITE_PAGES`` pages and lines on fewer than ``MIN_LINE_PAGES`` are
left alone; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckframe.llm.words import has_word, lines
from deckframe.plans import fresh, stored
from deckframe.plans.tables import BROADCAST_ROWS

MAX_RATIO = 0.05
MIN_SITE_PAGES = 10
MIN_LINE_PAGES = 5
#: Parts that a site's pages are dealt to where its lines are not broadcast.
SALTS = 64


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))


def boilerplate(
    pages: DataFrame,
    site: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_site_pages: int = MIN_SITE_PAGES,
    min_line_pages: int = MIN_LINE_PAGES,
) -> DataFrame:
    """One row for each site with boilerplate: site, drop (hashes of its lines)."""
    base = pages.select(F.col(site).alias("site"), F.col(text).alias("text"))
    hashes = F.array_distinct(F.transform(F.filter(lines(F.col("text")), has_word), lambda x: F.xxhash64(x)))
    shared = (
        base.select("site", F.explode_outer(hashes).alias("line"))
        .where(F.col("line").isNotNull())
        .groupBy("site", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_line_pages)
    )
    totals = base.groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_site_pages)
    s, t = shared.alias("s"), totals.alias("t")
    common = s.join(t, F.col("s.site").eqNullSafe(F.col("t.site"))).where(F.col("n") > max_ratio * F.col("pages"))
    return stored(common.groupBy("s.site").agg(F.sort_array(F.collect_list("line")).alias("drop")), "boilerplate")


def dedup_lines(pages: DataFrame, site: str = "source", text: str = "text", **limits: float) -> tuple[DataFrame, str, str]:
    """``pages`` with ``text`` cleaned and two columns more, whose names come back: lines before, lines dropped."""
    drop, salt, key, n, gone, left = fresh(pages, "_drop", "_salt", "_site", "_n_lines", "_n_removed", "_left")
    lists = boilerplate(pages, site, text, **limits).select(F.col("site").alias(key), F.col("drop").alias(drop))
    size = lists.agg(F.coalesce(F.sum(F.size(drop) + 1), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        joined = pages.join(F.broadcast(lists), F.col(site).eqNullSafe(F.col(key)), "left")
    else:
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pages.withColumn(salt + "_", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = dealt.join(lists, F.col(site).eqNullSafe(F.col(key)) & (F.col(salt + "_") == F.col(salt)), "left").drop(salt, salt + "_")
    every = lines(F.col(text))
    kept = F.when(F.col(drop).isNull(), every).otherwise(F.filter(every, lambda x: ~has_word(x) | ~F.array_contains(drop, F.xxhash64(x))))
    out = joined.withColumn(left, kept).withColumn(n, F.size(every).cast("long")).withColumn(gone, F.col(n) - F.size(left))
    out = out.withColumn(text, F.when(F.col(gone) > 0, F.array_join(left, "\n")).otherwise(F.col(text)))
    return out.select(*pages.columns, n, gone), n, gone
