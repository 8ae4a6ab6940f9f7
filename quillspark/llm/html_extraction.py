"""Main text of web pages by consensus paths of their hosts.

1. An Arrow pass parses each page into blocks of text outside menus, forms, adverts and the like, each with its
   generalised container path (tags and classes, digits folded). The page's own choice is the deepest path that holds
   all of that text; only the choices leave the pass.
2. Spark adds up these choices per host, weighted by the logarithm of their text, and the path with the most wins. Pages
   vote with hashes of their blocks as well: what three pages of a host and half of them all have at one path is its
   furniture.
3. Every page is parsed anew. Where its host's winning path holds more than half of its text, the page is extracted
   with that path, raised within the page's body to the container of further text; any other page uses its own. Furniture
   is cut, but not from the container of most of the page's text, and not where it is half of the page or more, as in
   copies of a page.

A hot host's votes are folded before the shuffle, and the winners, one row per host, meet the pages in a join that
adaptive execution splits or broadcasts by size.

Defined results: null or empty html and pages without text give an empty string; a page with a null or odd url has no
host and uses its own path; repeated rows are extracted each; other columns are ignored; an empty table gives no rows;
very long pages are parsed whole. Unclosed elements end with their parents, truncated pages with the page. Where names
leave nothing of a page, an <article> or <main> below a part so named counts after all.
"""

from __future__ import annotations

import hashlib
import html
import math
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, require
from quillspark.llm.kernels import rows_of

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|select|canvas|noembed|title|annotation|annotation-xml"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle mspace".split())
LEFT_OUT = frozenset("nav footer aside form button dialog head menu".split())
HEADER = "header"

# What names of classes and ids say about a part of a page that isn't the article.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion promotions banner banners cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe signup paywall sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar header footer foot "
    "comment comments commentlist disqus replies discussion share sharing social follow related recommended recommendations trending widget widgets tags copyright legal".split()
)
# Parts of an article, and what stands before or after a name that only says how a page is laid out.
CONTENT = frozenset("article content entry main post page story text title body section".split())
LAYOUT = frozenset("has with without no is layout".split())
NAME_PART = re.compile(r"[a-z]+")


ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:[^>\"'/]|\"[^\"]*\"|'[^']*'|/(?!>))*/>|<(?P<raw>" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SPACE = re.compile(r"\s+")


def outside_name(name: str, in_article: bool) -> bool:
    """Whether one class or id says that its element isn't part of the article.

    A name of several parts does so by its first or last part; "has-sidebar" and "sidebar-layout" speak of the page, and
    the header of an article belongs to it.
    """
    parts = NAME_PART.findall(name.lower())
    if not parts or parts[0] in LAYOUT or parts[-1] in LAYOUT:
        return False
    if parts[-1] == "header" and (in_article or len(parts) > 1 and parts[0] in CONTENT - {"page", "main"}):
        return False
    if parts[0] in OUTSIDE:
        return True
    return parts[-1] in OUTSIDE and (len(parts) == 1 or not (parts[-1] in ("side", "legal", "notice", "notices") and in_article))


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(container path, text) of the blocks that may belong to the article, in page order."""
    return parsed(page, False) or (parsed(page, True) if re.search(r"<(?:article|main)\b", page, re.I) else [])


def parsed(page: str, reopen: bool) -> list[tuple[str, str]]:
    """reopen: an <article> or <main> counts also below a part that isn't of the article by its name."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, left out
    parts: list[str] = []
    path, skip, at = "", False, 0

    def end_block() -> None:
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
            if text:
                out.append((path, text))
            parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at and not skip:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in INLINE and not m["rest"] and not m["close"] and not skip:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        end_block()
                    del stack[k:]
                    _, path, skip = stack[-1] if stack else ("", "", False)
                    break
            continue
        names = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m["rest"])} if m["rest"].strip(" /") else {}
        in_article = any(t[0] in ("article", "main") for t in stack)
        if reopen and skip and tag in ("article", "main") and not any(t[0] in LEFT_OUT for t in stack):
            skip = False
        outside = (
            skip or tag in LEFT_OUT or tag == HEADER and not in_article
            or tag not in ("html", "body", "article", "main") and bool(names) and (
                any(outside_name(n, in_article) for n in f"{names.get('class', '')} {names.get('id', '')}".split()) or names.get("role", "").lower() in ROLES
                or "hidden" in names or names.get("aria-hidden", "").lower() == "true"
            )
        )
        if tag in INLINE:
            # a marked inline part, such as a share link, is left out up to its end, which those like it inside don't make
            if outside and (not skip or any(t[0] == tag for t in stack)):
                stack.append((tag, path, True))
                skip = True
            continue
        end_block()
        if tag in VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            stack.pop()
            path, skip = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            outside = outside and (skip or tag in LEFT_OUT)
        if tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "pre", "blockquote", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption", "center"):
            name = re.sub(r"\d+", "0", ".".join(sorted(names.get("class", "").lower().split())))
            path = f"{path}/{tag}.{name}" if name else f"{path}/{tag}"
        stack.append((tag, path, outside))
        skip = outside
    if at < len(page) and not skip:
        parts.append(page[at:])
    end_block()
    return out


def held_by(blocks: list[tuple[str, str]], path: str) -> int:
    return sum(len(t) for p, t in blocks if p == path or p.startswith(path + "/"))


def own_path(blocks: list[tuple[str, str]]) -> tuple[str, int]:
    """The deepest container path that holds all of the text, and its characters."""
    best = "/".join(os.path.commonprefix([p.split("/") for p, _ in blocks]))
    return best, held_by(blocks, best)


def chosen_path(blocks: list[tuple[str, str]], consensus: str | None) -> str:
    """The consensus, raised to the highest container in the body that adds text, or the page's own path."""
    own, total = own_path(blocks)
    if consensus is None or 2 * held_by(blocks, consensus) <= total:
        return own
    best, steps = consensus, consensus.split("/")
    for k in range(len(steps) - 1, 1, -1):
        if steps[k - 1].split(".")[0] in ("html", "body"):
            break
        above = "/".join(steps[:k])
        if held_by(blocks, above) > held_by(blocks, best):
            best = above
    return best


def block_hash(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def without_furniture(blocks: list[tuple[str, str]], furniture: set[int]) -> list[tuple[str, str]]:
    """The blocks without those of the host's furniture that lie outside the container of most of the text."""
    if not furniture or not blocks:
        return blocks
    weights: dict[str, int] = {}
    for p, t in blocks:
        weights[p] = weights.get(p, 0) + len(t)
    main = max(weights, key=lambda p: (weights[p], -len(p), p))
    kept = [(p, t) for p, t in blocks if p == main or p.startswith(main + "/") or block_hash(p, t) not in furniture]
    return kept if 2 * sum(len(t) for _, t in kept) > sum(weights.values()) else blocks


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, path, block, weight): each page's own choice, and each of its blocks once with a null path."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            hosts, paths, hashes, weights = [], [], [], []
            for host, page in rows_of(batch.slice(at, 512)):
                blocks = blocks_of(page or "")
                path, held = own_path(blocks)
                own = {block_hash(p, t) for p, t in blocks}
                hosts += [host] * (1 + len(own))
                paths += [path, *[None] * len(own)]
                hashes += [None, *own]
                weights += [math.log1p(held), *[0.0] * len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.int64()), pa.array(weights, pa.float64())], names=["host", "path", "block", "weight"])


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, consensus, furniture) -> (page_id, url, text, n_chars, path)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("path", pa.string())])
    for batch in batches:
        rows = []
        for i, url, page, consensus, furniture in rows_of(batch):
            blocks = without_furniture(blocks_of(page or ""), set(furniture or ()))
            path = chosen_path(blocks, consensus)
            text = " ".join(t for p, t in blocks if p == path or p.startswith(path + "/"))
            rows.append({"page_id": i, "url": url, "text": text, "n_chars": len(text), "path": path})
        yield pa.RecordBatch.from_pylist(rows, schema)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, consensus and furniture (hashes of blocks) of each host that has any text; pages: host, html."""
    votes = pages.where("host <> ''").mapInArrow(vote, "host string, path string, block long, weight double")
    votes = checkpointed(votes.groupBy("host", "path", "block").agg(F.round(F.sum("weight"), 6).alias("votes"), F.count(F.lit(1)).alias("n")).where("n > 2 OR path IS NOT NULL"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("path")))
    chosen = votes.where("path IS NOT NULL AND votes > 0").withColumn("place", place).where("place = 1").select("host", F.col("path").alias("consensus"))
    pages_of = votes.where("path IS NOT NULL").groupBy("host").agg(F.sum("n").alias("pages"))
    common = votes.where("block IS NOT NULL").join(pages_of, "host").where("2 * n >= pages").groupBy("host").agg(F.collect_set("block").alias("furniture"))
    return checkpointed(chosen.join(common, "host", "left"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page, and the path that was used."""
    rows = require(pages, [id_col, url_col, html_col]).toDF("page_id", "url", "html")
    rows = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    joined = rows.join(host_paths(rows.select("host", "html")), "host", "left").select("page_id", "url", "html", "consensus", "furniture")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long, path string").withColumnsRenamed({"page_id": id_col, "url": url_col})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
