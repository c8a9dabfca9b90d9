"""Main text of web pages by wrapper induction (operator 5).

Pages of a host are grouped by layout, the kinds of blocks they are made of, and each is aligned
with one page of its layout by simple tree matching.  Runs of text that stay the same in place on
the layout's pages are template; runs that vary are slots.  The text of a page is what fills the
slots of its article.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .batches import returning, small_batches
from .dom import Leaves, align

# A run of text is template if it stays the same on this share of at least so many pages.
CONSTANT_SHARE = 0.8
MIN_PAGES = 5
# Pages that repeat nearly all of the reference say nothing about what is constant.
COPY_SHARE = 0.9
# Layouts of all hosts up to this number are sent to every task; beyond, they are joined.
BROADCAST_LAYOUTS = 100_000
# Reference pages of all layouts up to this size are sent to every task; beyond, they are joined.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


_BLOCK = r"(?i)<(?:article|aside|div|footer|form|header|main|nav|section|table)(?=[\s>/])[^>]*"
_CLASS = r"""\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def layout_of(html: Column) -> Column:
    """Hash of the kinds of block elements (tag and class, without digits) that a page holds."""
    kinds = F.transform(
        F.array_distinct(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(0))),
        lambda x: F.concat(
            F.regexp_extract(F.lower(x), r"^<([a-z]+)", 1), F.lit(" "),
            F.regexp_replace(F.regexp_extract(F.lower(x), _CLASS, 1), r"[0-9\"']+", ""),
        ),
    )
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(kinds)), "\n"))


def _grouped(pages: DataFrame, kinds: DataFrame, few: bool) -> DataFrame:
    """Rows of pages with the layout they are aligned in: their own, or their host's most frequent one.

    ``kinds`` holds the layouts that enough pages of a host have; a host without any is one group.
    """
    first = kinds.groupBy("host").agg(F.max_by("layout", F.struct("n", "layout")).alias("__first"))
    own = kinds.select("host", "layout", F.col("layout").alias("__own"))
    hint = F.broadcast if few else (lambda df: df)
    joined = pages.join(hint(own), ["host", "layout"], "left").join(hint(first), "host", "left")
    return joined.withColumn("layout", F.coalesce("__own", "__first", F.lit(0).cast("long"))).drop("__own", "__first")


def _references(pages: DataFrame, sized: DataFrame) -> DataFrame:
    """(host, layout, reference): of each layout the page whose length is nearest to the lower quartile."""
    typical = sized.groupBy("host", "layout").agg(F.percentile_approx("n", 0.25, 200).alias("typical"))
    near = F.struct(F.abs(F.col("n") - F.col("typical")), "page_id", "mark")
    pick = sized.join(typical, ["host", "layout"]).groupBy("host", "layout").agg(F.min(near).alias("pick"))
    chosen = cut(
        pick.select(
            F.col("host").alias("__host"), "layout", F.col("pick.page_id").alias("__id"), F.col("pick.mark").alias("__mark")
        ),
        "page-picks",
    )
    same = (F.col("host") == F.col("__host")) & F.col("page_id").eqNullSafe(F.col("__id")) & (F.xxhash64("html") == F.col("__mark"))
    return pages.drop("layout").join(chosen, same).groupBy("host", "layout").agg(F.min("html").alias("reference"))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per layout and reference run: pages it was aligned on, and on how many it was the same."""
    leaves = lru_cache(64)(Leaves)
    for pdf in batches:
        seen: dict[tuple[str, int, int], list[int]] = {}
        for host, layout, page, reference in zip(pdf["host"], pdf["layout"], pdf["html"], pdf["reference"]):
            ref, mine = leaves(reference), Leaves(page)
            places = align(ref, mine)
            equal = {r: mine.texts[p] == ref.texts[r] for p, r in places.items()}
            if not places or sum(equal.values()) >= COPY_SHARE * len(ref.texts):
                continue
            for r, same in equal.items():
                count = seen.setdefault((host, layout, r), [0, 0])
                count[0] += 1
                count[1] += same
        if seen:
            yield pd.DataFrame([(*key, n, k) for key, (n, k) in seen.items()], columns=["host", "layout", "run", "n", "same"])


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    leaves = lru_cache(64)(Leaves)
    for pdf in batches:
        texts = []
        for page, reference, constant in zip(pdf["html"], pdf["reference"], pdf["constant"]):
            mine = Leaves(page)
            fixed: set[int] = set()
            if reference is not None and constant is not None and len(constant):
                template = set(constant)
                fixed = {p for p, r in align(leaves(reference), mine).items() if r in template}
            texts.append(" ".join(mine.main_text(fixed)))
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html.

    The text is that of the article (``main``, ``article``, or the body where articles are only
    teasers) without menus, headers, footers, sidebars, notices, adverts, forms, comments, and
    without what the layout repeats in place.  A class or id that names nothing but such a part
    marks it; one that mentions it among other words does so only for a block that is mostly
    links.  Character references are decoded, white space inside a block becomes one space,
    blocks are joined by one space.  Null and empty html give an empty text; a null or odd url is
    a host of its own; broken markup is read as far as it goes; repeated rows are kept; other
    columns are ignored; an empty table gives an empty one.  Two pages are aligned by their
    largest match however many siblings they have.
    """
    small_batches(pages.sparkSession)
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).withColumns({"host": host_of(F.col("url")), "layout": layout_of(F.col("html"))})
    sized = cut(
        plain.where(F.length("html") > 0)
        .select("host", "layout", "page_id", F.length("html").alias("n"), F.xxhash64("html").alias("mark")),
        "page-sizes",
    )
    kinds = cut(sized.groupBy("host", "layout").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES), "page-layouts")
    few = kinds.count() <= BROADCAST_LAYOUTS
    refs = cut(_references(plain, _grouped(sized, kinds, few)), "page-references")
    small = (refs.agg(F.sum(F.octet_length("reference"))).first()[0] or 0) <= BROADCAST_BYTES
    grouped = _grouped(plain, kinds, few)
    seen = grouped.where(F.length("html") > 0).join(F.broadcast(refs) if small else refs, ["host", "layout"])
    counts = seen.select("host", "layout", "html", "reference").mapInPandas(
        returning(_compare), "host string, layout long, run int, n long, same long"
    )
    votes = counts.groupBy("host", "layout", "run").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    fixed = votes.where((F.col("n") >= MIN_PAGES) & (F.col("same") >= CONSTANT_SHARE * F.col("n")))
    # At most the text runs of one page.
    template = fixed.groupBy("host", "layout").agg(F.collect_list("run").alias("constant"))
    wrappers = cut(refs.join(template, ["host", "layout"]), "page-wrappers")
    wrapped = grouped.join(F.broadcast(wrappers) if small else wrappers, ["host", "layout"], "left")
    found = wrapped.select("page_id", "url", "html", "reference", "constant").mapInPandas(
        returning(_fill), "page_id long, url string, text string"
    )
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
