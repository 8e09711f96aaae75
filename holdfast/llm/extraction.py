"""Main text of web pages by template deduction (operator 3).

Tokens are tags and words with the path of elements around them. A token's occurrence vector says how often
it stands on each page of a host; tokens with the same vector are one equivalence class. Vectors
are compared by a signature that adds up over any parts of a host. Pages meet by host; large hosts are cut at random
into parts of about 1,000 pages. A part sends on the tokens that more than half of ``share`` of its pages have; their counts over the whole host then rule
them in or out (that a token of more than ``share`` is that rare in 1,000 random pages is less likely than that two signatures are equal). A class is valid with ``least``
tokens, on more than ``share`` of the pages of a host of ``many`` pages or more (empty ones don't count), in the same order everywhere, and
nested in one slot of the host's root: the largest class that stands once on each of the most pages. Pages without the root have no template. Words
alone that stand on a part of the pages are taken for a block only if it holds ``least`` of them, since a few may meet on
the same pages by chance. The valid classes are the host's template; what lies between is slots. A page's text is
its slots: blocks that hold more than template words, outside the elements that are no article by
name (menus, headers, footers, sidebars, notices, adverts, forms, comments, code), and inside the article
element where the page has one. Pages of small hosts have no template; names alone decide.

Null and empty pages give the empty text, null URLs the host ''. Malformed markup is read as far as it goes; an open comment ends with the
page. Pages are read whole. Repeated rows each give a row. Only id, url and html are looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.rows import wide
from holdfast.llm.urlrules import host_and_path
from holdfast.storage import spread, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Names of elements and the words that mark them.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img input br".split())
APART = frozenset("head nav footer aside form button select svg canvas object dialog menu audio video".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
MARKS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                  "notices popup modal overlay newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
                  "comment comments disqus reply replies share sharing social related recommended widget login signup search form "
                  "toolbar pagination pager skip".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}


class Element:
    __slots__ = ("name", "path", "apart", "article")

    def __init__(self, name: str, attributes: str, outer: Element | None):
        said = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        marks = set(re.split(r"[^a-z0-9]+", f"{said.get('class', '')} {said.get('id', '')}"))
        inside = outer is not None and outer.article
        self.name = name
        self.path = f"{outer.path if outer else ''}/{name}.{said.get('class', '')}" if outer or said else f"/{name}."
        own = name in ("article", "main") or said.get("role") == "main" or said.get("itemprop") == "articlebody"
        self.apart = bool(outer and outer.apart) or name in APART or bool(marks & MARKS) or said.get("role") in ROLES \
            or (not inside and (name == "header" or "header" in marks)) or "hidden" in said \
            or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "")
        self.article = inside or (own and not self.apart)


def walk(html: str) -> list[tuple]:
    """The page as ('tag', element, name) and ('block', element, words) in order."""
    items: list[tuple] = []
    stack = [Element("page", "", None)]
    held: list[str] = []

    def close_block():
        words = "".join(held).split()
        held.clear()
        if words:
            items.append(("block", stack[-1], words))

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        run = html[at:m.start()] if m else html[at:]
        if run:
            held.append(unescape(run) if "&" in run else run)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                continue
            close_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    items.append(("tag", stack[-1], f"/{name}"))
                    break
            continue
        if name == "br":
            held.append(" ")
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
        if name in INLINE or name in RAW:
            continue
        close_block()
        for shut in CLOSES.get(name, ("p",)):
            if len(stack) > 1 and stack[-1].name == shut:
                del stack[-1]
        element = Element(name, m[3] or "", stack[-1])
        items.append(("tag", element, name))
        if name not in VOID and not (m[3] or "").endswith("/"):
            stack.append(element)
    close_block()
    return items


def tokens(items: list[tuple]) -> Iterator[tuple[str, str]]:
    for kind, element, what in items:
        if kind == "tag":
            yield element.path, f"<{what}>"
        else:
            for word in what:
                yield element.path, word


KINDS = {"host": pa.string(), "path": pa.string(), "word": pa.string(), "sign": pa.int64(), "place": pa.int64(), "once": pa.bool_(), "pages": pa.int64()}


def _counted(items: list[tuple]) -> dict[str, tuple[Counter, dict[str, int]]]:
    """Per path: how often its tokens stand on the page, and where first."""
    out: dict[str, tuple[Counter, dict[str, int]]] = {}
    at = 0
    for kind, element, what in items:
        own = (f"<{what}>",) if kind == "tag" else what
        counts, first = out.get(element.path) or out.setdefault(element.path, (Counter(), {}))
        counts.update(own)
        for place, word in enumerate(own, at):
            if word not in first:
                first[word] = place
        at += len(own)
    return out


def _vectors(part: pa.Table, least: float, many: int) -> pa.Table:
    """Tokens that more than ``least`` of a part's pages have, with signature, sum of first places and number of pages."""
    from xxhash import xxh64_intdigest

    known: dict[str, dict[str, list]] = {}
    host, cut = (part[c][0].as_py() for c in ("host", "cut"))
    for row, html in enumerate(part["html"] if part.num_rows >= many else []):
        marks: dict[int, int] = {}
        for path, (counts, first) in _counted(walk(html.as_py())).items():
            of_path = known.setdefault(path, {})
            for word, n in counts.items():
                mark = marks.get(n) or marks.setdefault(n, xxh64_intdigest(f"{cut}:{row}:{n}"))
                old = of_path.get(word)
                if old is None:
                    of_path[word] = [mark, first[word], n == 1, 1]
                else:
                    old[0] ^= mark
                    old[1] += first[word]
                    old[2] = old[2] and n == 1
                    old[3] += 1
    rows = [(host, path, word, sign - (1 << 64) if sign >> 63 else sign, place, once, pages)
            for path, words in known.items() for word, (sign, place, once, pages) in words.items() if pages > least * part.num_rows]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, KINDS.values())], list(KINDS))


def templates(pages: DataFrame, least: int = 3, many: int = 8, share: float = 0.5, pages_in_part: int = 1000, chars_in_part: int = 32_000_000) -> DataFrame:
    """host, root (tokens of the root class, in order) and inner (the other classes: whole, whether on all of the root's pages, and of)."""
    filled = pages.where(F.col("html").rlike(r"\S"))
    total = written(filled.groupBy("host").agg(F.count("*").alias("total"), F.sum(F.length("html")).alias("chars"))
                    .where(F.col("total") >= many), "host-pages")
    cuts = F.ceil(F.greatest(F.col("total") / pages_in_part, F.col("chars") / chars_in_part)).cast("int")
    large = total.select("host", cuts.alias("cuts")).where("cuts > 1")  # at most one row for each part
    parts = filled.withColumn("mark", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(large), "host", "left") \
        .select("host", F.coalesce(F.pmod("mark", "cuts"), F.lit(0)).alias("cut"), "html").repartition(wide(pages.sparkSession), "host", "cut")
    found = parts.groupBy("host", "cut").applyInArrow(
        lambda part: _vectors(part, share / 2, many), "host string, path string, word string, sign long, place long, once boolean, pages long") \
        .groupBy("host", "path", "word").agg(
            F.bit_xor("sign").alias("sign"), F.sum("place").alias("place"), F.every("once").alias("once"), F.sum("pages").alias("pages"))
    often = found.join(total, "host").where(F.col("pages") > share * F.col("total"))
    classes = often.groupBy("host", "sign", "pages", "once").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "path", "word"))).alias("of")).where(F.col("n") >= least)
    flat = F.transform("of", lambda t: F.concat(t["path"], F.lit(" "), t["word"]))
    own = written(classes.select("host", "sign", "once", "pages", "n", flat.alias("of")), "classes")
    roots = own.where("once").groupBy("host").agg(F.max(F.struct("pages", "n", "sign", "of")).alias("root"))
    rest = own.join(roots, "host").where(F.col("sign") != F.col("root.sign")).groupBy("host").agg(
        F.collect_list(F.struct((F.col("pages") == F.col("root.pages")).alias("whole"), "of")).alias("inner"))
    return roots.select("host", "root.of").withColumnRenamed("of", "root").join(rest, "host", "left")


def main_text(html: str, root: list[str], inner: list[dict], least: int = 3) -> str:
    """The blocks of the remaining slots, joined by two line ends."""
    items = walk(html)
    fixed: set[tuple[str, str]] = set()
    loose: dict[tuple[str, str], int] = {}
    if root:
        rank, level, slots, order = {t: k for k, t in enumerate(root)}, -1, {}, []
        member = {t: k for k, group in enumerate(inner) for t in group["of"]}
        for token in tokens(items):
            name = " ".join(token)
            if name in rank:
                if rank[name] > level:  # in the order of the template
                    level = rank[name]
                    order.append(token)
            elif name in member:
                slots.setdefault(member[name], {}).setdefault(level, set()).add(token)
        if order:
            fixed.update(order)
            for k, at in slots.items():
                if len(at) == 1:  # a class that spreads over slots is not nested
                    own = set().union(*at.values())
                    fixed.update(own)
                    if not inner[k]["whole"] and not any(word.startswith("<") for _, word in own):
                        loose.update(dict.fromkeys(own, k))

    def of_template(element, words: list[str]) -> bool:
        own = {(element.path, word) for word in words}
        return own <= fixed and all(n >= least for n in Counter(loose[t] for t in own if t in loose).values())

    blocks = [(e, w) for kind, e, w in items if kind == "block"]
    within = any(e.article for e, _ in blocks)
    return "\n\n".join(
        " ".join(words) for e, words in blocks
        if not e.apart and (e.article or not within) and not of_template(e, words))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url and text."""
    host, _ = host_and_path(F.col(url_col).cast("string"))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = spread(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), host.alias("host")))
    deduced = written(templates(rows.select("host", "html")), "templates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), r.as_py() or [], i.as_py() or [])
                     for h, r, i in zip(batch.column(2), batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    return rows.join(deduced, "host", "left").select("page_id", "url", "html", "root", "inner") \
        .mapInArrow(cut, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
