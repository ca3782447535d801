"""Extraction from landed pages: tables, bibliographies, links, abstracts, keywords and keyed numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import number_or_null

# Page structure the extraction looks for.
TABLE_BODY = r'(?is)<tbody[^>]*class="[^"]*\bdatatable\b[^"]*"[^>]*>(.*?)</tbody>'
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<td[^>]*>(.*?)</td>"
TAG = r"(?s)<[^>]*>"
HREF = r'(?i)<a\b[^>]*\bhref="([^"]*)"'
TITLE_HEADING = r'(?is)<h2[^>]*class="[^"]*\bs-abstract-title\b[^"]*"[^>]*>(.*?)</h2>'
ABSTRACT_BLOCK = r'(?is)<div[^>]*class="[^"]*\bs-abstract-text\b[^"]*"[^>]*>(.*?)</div>'
KEYWORD_LIST = r'(?is)<ul[^>]*class="[^"]*\blist-inline\b[^"]*"[^>]*>(.*?)</ul>'
LIST_ITEM = r"(?is)<li[^>]*>(.*?)</li>"
PREPRINT_LINK = r'(?is)<a\b[^>]*\bhref="[^"]*/arXiv:[^"]*"[^>]*>(.*?)</a>'
DETAIL_BLOCK = r'(?is)<dl[^>]*class="[^"]*\bs-abstract-dl-horizontal\b[^"]*"[^>]*>(.*?)</dl>'
PREPRINT_URL = "https://arxiv.org/abs/"
ABSTRACT_URL = "https://ui.adsabs.harvard.edu/abs/%s/abstract"
ABSTRACT_LINK_LABEL = "View the reference in ADS"
DETAIL_KEYS = ["Redshift"] + [f"Flux {b}" for b in "UBVGRIZJHK"] + [f"Flux {b}" for b in "ubvgriz"]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, or null when there is none."""
    return F.get(_all(text, pattern, group), F.lit(0))


def plain(fragment: Column) -> Column:
    """Text of a fragment: tags dropped, outer white space trimmed."""
    return F.regexp_replace(F.regexp_replace(fragment, TAG, ""), r"^\s+|\s+$", "")


def table_rows(pages: DataFrame, id_col: str, html: str = "html", limit: int | None = None) -> DataFrame:
    """(id, row_no, cells) of the page's data table; a page without one gives no rows. ``limit`` keeps the first rows."""
    rows = _all(_first(F.col(html), TABLE_BODY), ROW)
    if limit is not None:
        rows = F.slice(rows, 1, limit)
    long = pages.select(id_col, F.posexplode(rows).alias("row_no", "_row"))
    return long.select(id_col, "row_no", F.transform(_all(F.col("_row"), CELL), plain).alias("cells"))


def bibliography(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """(id, refcode, score, relevance_code, title) from the cells 0, 1, 2 and 8; order by score is up to the reader."""
    cell = lambda i: F.get("cells", F.lit(i))
    return table_rows(pages, id_col, html).select(
        id_col,
        "row_no",
        cell(0).alias("refcode"),
        cell(1).try_cast("int").alias("score"),
        cell(2).alias("relevance_code"),
        cell(8).alias("title"),
    )


def links_containing(pages: DataFrame, id_col: str, fragment: str, html: str = "html") -> DataFrame:
    """Distinct (id, link) whose address contains the fragment."""
    found = F.filter(F.array_distinct(_all(F.col(html), HREF)), lambda u: u.contains(fragment))
    return pages.select(id_col, F.explode(found).alias("link"))


def title_and_abstract(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """(id, title, description); pages without a title or an abstract block give no record."""
    title = plain(_first(F.col(html), TITLE_HEADING))
    text = plain(F.replace(plain(_first(F.col(html), ABSTRACT_BLOCK)), F.lit("Abstract"), F.lit("")))
    return pages.select(id_col, title.alias("title"), text.alias("description")).dropna(subset=["title", "description"])


def keyword_list(html: Column) -> Column:
    """Items of all inline lists, semicolons removed."""
    items = F.flatten(F.transform(_all(html, KEYWORD_LIST), lambda ul: _all(ul, LIST_ITEM)))
    return F.transform(items, lambda li: plain(F.replace(plain(li), F.lit(";"), F.lit(""))))


def paper_link(html: Column, refcode: Column) -> Column:
    """Preprint address when the detail block links one, else the abstract page."""
    label = plain(F.replace(plain(_first(_first(html, DETAIL_BLOCK), PREPRINT_LINK)), F.lit("arXiv:"), F.lit("")))
    return F.coalesce(F.concat(F.lit(PREPRINT_URL), label), F.format_string(ABSTRACT_URL, refcode))


def keyed_numbers(text: Column, keys: Sequence[str] = DETAIL_KEYS) -> list[Column]:
    """Per key: first line that contains it, colons to blanks, key removed, first word as number. Keys are case-sensitive."""
    lines = F.split(text, "\n")

    def number(key: str) -> Column:
        line = F.get(F.filter(lines, lambda x: F.contains(x, F.lit(key))), F.lit(0))
        spaced = F.trim(F.regexp_replace(F.replace(line, F.lit(":"), F.lit(" ")), " +", " "))
        rest = F.trim(F.replace(spaced, F.lit(key), F.lit("")))
        return number_or_null(F.get(F.split(rest, " "), F.lit(0)))

    return [number(k).alias(k) for k in keys]


def labelled_link_id(html: Column, label: str = ABSTRACT_LINK_LABEL) -> Column:
    """Last path segment of the first link with exactly this label."""
    anchors = _all(html, r"(?is)<a\b[^>]*>.*?</a>", 0)
    hit = F.get(F.filter(anchors, lambda a: plain(a) == label), F.lit(0))
    return F.element_at(F.split(_first(hit, HREF), "/"), -1)
