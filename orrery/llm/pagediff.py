"""Main text of web pages: structure first, then differencing against the nearest address of the same host.

A page is read into lines: one per block element, character references decoded, white space folded. Lines in places
that are never the article (menus, headers, footers, sidebars, forms, notices, adverts, reader comments, scripts) are
left out by element, role and class. What remains is either inside an article or main element, and safe, or open.

Pages of a host with the same lines are folded, put in order of their paths and cut into blocks of ``BLOCK_PAGES`` (the
last takes the rest), which also read ``HALO_PAGES`` pages on both sides, so that a large host spreads. In a
block every page is paired with the nearest address whose lines differ enough to tell a template from a copy, the two
lists of lines are aligned by their longest common subsequence, and open lines that both share are deleted. Where a
page has an article element, open lines outside it are not part of the text in any case; so shared passages of two
articles stay, and menus that no neighbour shares go. Pages that meet only copies of themselves are compared again, with
pages spread evenly over their host.

Defined cases: null html is empty; a null address belongs to the host with the empty name; rows with the same page_id, url
and html get the same text; other columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orrery.llm.helpers import group_bounds, stored, whole_groups
from orrery.operators.ordered import number_rows

BLOCK_PAGES = 32
HALO_PAGES = 8
# Pages that share more of their lines than this are taken for copies, unless all pages do.
COPY_SHARE = 0.8
BROADCAST_BYTES = 32 << 20

RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "xmp", "object", "canvas"}
NEVER = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"body", "html", "tbody", "thead", "tfoot", "tr"}
SIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert popup "
    "modal overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond "
    "share sharing social newsletter subscribe related recommended pagination pager toolbar login search".split()
)
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
# Inside an article these name its own title and sections, unless they are joined to a word for lists of links.
OWN_NAMES = {"header", "masthead", "banner", "related", "recommended"}
LINK_LISTS = {"posts", "links", "articles", "stories", "news", "content", "reading", "box"}
# Attributes in their order, name and value: what stands inside a value is never taken for a name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def is_side(name: str, attributes: str, inside: bool = False) -> bool:
    """Is this element's content never part of the article, by its name, role or class? ``inside``: it lies in an article."""
    if name in NEVER:
        return True
    if not attributes or name in ("body", "html", "main", "article"):
        return False
    own = SIDE_NAMES - OWN_NAMES if inside else SIDE_NAMES
    seen = set()
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in seen:
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in SIDE_ROLES:
            return True
        if key in ("class", "id"):
            for part in value.split():
                words = re.split(r"[-_]+", part)
                if words[0] in ("has", "no", "with", "without", "is"):
                    continue
                if own.intersection(words) or OWN_NAMES.intersection(words) and LINK_LISTS.intersection(words):
                    return True
    return False


def page_lines(html: str | None) -> list[tuple[str, bool]]:
    """(line, safe) in page order; if the page has an article or main element, only the lines in it, which are safe."""
    html = html or ""
    lines: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, left out, in an article
    text: list[str] = []
    linked = plain = 0

    def flush() -> None:
        nonlocal linked, plain
        line = " ".join(references.unescape("".join(text)).split())
        if line:
            lines.append((line, bool(stack and stack[-1][2]), linked > 0 and plain == 0))
        text.clear()
        linked = plain = 0

    def say(piece: str) -> None:
        nonlocal linked, plain
        if piece and not (stack and stack[-1][1]):
            text.append(piece)
            size = len(piece.strip())
            if any(s[0] == "a" for s in stack):
                linked += size
            else:
                plain += size

    def pop_to(names: set[str], stops: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    at = 0
    while True:
        m = TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCKS:
                flush()
            if name in ("td", "th"):
                say(" ")
            if any(s[0] == name for s in stack):
                pop_to({name}, set())
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            say(" ")
            continue
        if name in ENDS_P:
            pop_to({"p"}, BLOCKS - {"p"})
        if name in CLOSES:
            pop_to(CLOSES[name], {"ul", "ol", "table", "dl", "select", "div", "section", "article", "nav"})
        if name in ("td", "th"):
            say(" ")
        out, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        side = is_side(name, m[3] or m[6] or "", inside) or name == "header" and not inside
        stack.append((name, out or side, inside or name in ("article", "main") and not out))
    flush()
    if any(safe for _, safe, _ in lines):
        return [(line, True) for line, safe, _ in lines if safe]
    # Without an article element, lines that are nothing but links are menus.
    return [(line, False) for line, _, menu in lines if not menu]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence, by the pairs of equal lines (Hunt and Szymanski)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k] = j
                chains[k] = link
    found = {*range(head), *range(len(a) - tail, len(a))}
    link = chains[-1] if chains else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def nearness(a: str, b: str) -> int:
    """Length of the common start of two paths."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shared_lines(paths: list[str], lines: list[list[int]], wanted: list[bool], least: list[bool] | None = None) -> list[set[int] | None]:
    """For each wanted page of a block, in path order: places of its lines that the nearest other page shares; None if
    there is only such as has the same lines, or the page is not wanted.

    Pages that share over ``COPY_SHARE`` of the lines are passed over for a farther one. If all do, their template is
    longer than their articles, and the page that shares least is taken (where ``least`` allows it, else None).
    """
    out: list[set[int] | None] = []
    for i, own in enumerate(lines):
        found, fewest = None, None
        if wanted[i]:
            nearest = sorted((j for j in range(len(lines)) if j != i), key=lambda j: (-nearness(paths[i], paths[j]), abs(i - j), j))
            for j in nearest:
                if own == lines[j]:
                    continue
                shared = common_lines(own, lines[j])
                part = len(shared) / max(len(own), len(lines[j]))
                if part <= COPY_SHARE:
                    found = shared
                    break
                if fewest is None or part < fewest[0]:
                    fewest = (part, shared)
            if found is None and fewest and (least is None or least[i]):
                found = fewest[1]
        out.append(found)
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def page_key() -> Column:
    return F.xxhash64("page_id", "url", "html")


def template_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): numbers of the open lines that a page shares with its nearest address, for pages that have any."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, host, path, html in zip(frame["key"], frame["host"], frame["path"], frame["html"]):
                lines = page_lines(html)
                numbers = np.array([xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line, _ in lines], np.uint64)
                out.append((key, host, path, bool(lines) and not lines[0][1], numbers.tobytes()))
            yield pd.DataFrame(out, columns=["key", "host", "path", "open", "lines"])

    slim = pages.select(page_key().alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    lines = stored(
        slim.mapInPandas(hashed, "key long, host string, path string, open boolean, lines binary")
        .dropDuplicates(["key"])
        .withColumn("fold", F.concat(F.md5("lines"), F.col("open").cast("string"))),
        "page-lines",
    )
    # Pages with equal lists of lines are one, at the first of their addresses.
    firsts = lines.groupBy("host", "fold").agg(F.min(F.struct("path", "key")).alias("_first")).select("host", "fold", "_first.*")
    firsts = stored(number_rows(firsts, ["host"], ["path", "key"]), "page-places")
    total, pos = F.col("pos_total"), F.col("pos")
    # A short rest joins the last block; pages near a cut are read by both blocks, and belong to one.
    last = F.greatest(F.floor(total / BLOCK_PAGES), F.lit(1)) - 1
    block_of = lambda at: F.least(F.floor(at / BLOCK_PAGES), last)
    near = F.sequence(block_of(F.greatest(pos - HALO_PAGES, F.lit(0))), block_of(pos + HALO_PAGES))
    placed = firsts.select("key", "host", "path", (last == 0).alias("least"), block_of(pos).alias("own"), F.explode(near).alias("block"))
    found = stored(differences(placed, lines), "template-lines")
    # Pages that met only copies of themselves go on against pages from all over their host.
    wide = firsts.filter(last > 0).select("key", "host", "path", "pos", "pos_total")
    alone = wide.join(found.filter("gone is null").select("key"), "key")
    alone = stored(alone.select("key", "host", "path", block_of(pos).alias("own")), "alone")
    step = F.ceil(total / BLOCK_PAGES)
    spread = wide.filter(F.pmod(pos, step) == 0).select("key", "host", "path", F.lit(-1).cast("bigint").alias("own"))
    guests = spread.join(alone.select("host", F.col("own").alias("block")).distinct(), "host").select("key", "host", "path", "own", "block")
    again = differences(alone.withColumn("block", F.col("own")).unionByName(guests).withColumn("least", F.lit(True)), lines)
    gone = stored(found.unionByName(again).filter(F.size("gone") > 0), "template-lines")
    named = firsts.select("key", "host", "fold").join(gone, "key").select("host", "fold", "gone")
    # Many pages can have the same lines: the short table goes to them.
    size = gone.agg(F.coalesce(F.sum(64 + 4 * F.size("gone")), F.lit(0))).first()[0]
    return stored(lines.select("key", "host", "fold").join(F.broadcast(named) if size <= BROADCAST_BYTES else named, ["host", "fold"]).select("key", "gone"), "template-lines")


def differences(placed: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, gone): for the open pages of ``placed`` (key, host, path, own, block, least) in their own block, the numbers of the
    lines shared with the nearest page of the block; null if every other page there is a copy (of pages with ``least``: has the same lines)."""

    def differenced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["host", "block"]):
            bounds = group_bounds(frame, ["host", "block"])
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                some = frame.iloc[a:b].drop_duplicates("key")
                wanted = (some["open"] & (some["own"] == some["block"])).tolist()
                if any(wanted):
                    numbers = [np.frombuffer(x, np.uint64).tolist() for x in some["lines"]]
                    found = shared_lines(some["path"].tolist(), numbers, wanted, some["least"].tolist())
                    out += [(key, None if gone is None else sorted(gone)) for key, gone, w in zip(some["key"], found, wanted) if w]
            yield pd.DataFrame(out, columns=["key", "gone"])

    blocks = placed.join(lines.select("key", "open", "lines"), "key")
    # Of a page that is in its own block and a guest there, the first counts.
    dealt = blocks.repartition("host", "block").sortWithinPartitions("host", "block", "path", "key", F.col("own").desc())
    return dealt.mapInPandas(differenced, "key long, gone array<int>")


def main_texts(pages: DataFrame) -> DataFrame:
    """The pages with ``text``, their main text (a column of this name is replaced)."""
    gone = template_lines(pages.select("page_id", "url", "html"))
    size = gone.agg(F.coalesce(F.sum(16 + 4 * F.size("gone")), F.lit(0))).first()[0]
    gone = gone.select(F.col("key").alias("_key"), F.col("gone").alias("_gone"))
    keyed = pages.withColumn("_page", page_key())
    met = keyed.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, F.col("_page") == F.col("_key"), "left")

    @F.pandas_udf("string")
    def text(htmls: pd.Series, gones: pd.Series) -> pd.Series:
        out = []
        for html, gone in zip(htmls, gones):
            left = set() if gone is None else {int(i) for i in gone}
            out.append("\n\n".join(line for i, (line, _) in enumerate(page_lines(html)) if i not in left))
        return pd.Series(out, dtype=object)

    return met.withColumn("text", text("html", "_gone")).drop("_page", "_key", "_gone")
