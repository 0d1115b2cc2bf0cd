"""Main text of HTML pages by a template that equivalence classes of a host's tokens give.

A page is a row of tokens: tags, told apart by the path of open elements above them, and pieces of
text. Tokens of a host's pages with equal occurrence vectors (the same number of times on the same
pages) form a class. A class that is on most pages of a host, whose tokens come once and in one
order on each page, is valid; the valid classes nest into the host's template. The parts of a page
between template tokens are its slots.

The text of the slots is taken; text that is itself a token of the template (the same on most of a
host's different pages) is left out, also in an article. An article or main element is a hint: text
outside of it is taken only from a slot that holds more than all articles of the page together.
Pages without a template go by article or main, or the whole body where a page has none. Menus,
notices, adverts, forms and comments are left out, told by element and by class, id or role; a
class or id gives way where the page's slots have no other text, or less of it and no article.

Pages of a host with the same text, copies or one article under several URLs, are one page for the
support of a template's text, however many rows they are. An article that is for the most part
template text is held by several pages, and stays whole.

Vectors are never gathered: a token's vector is a sum of hashes of (page, count), so classes come
from a grouped sum, in which a host of any size is pre-aggregated. Pages meet their host's template
in a join that Spark splits where a host is large."""

from __future__ import annotations

import html as html_module
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.store import kept
from meterlake.llm.text import lists, signed, texts

#: A valid class is on this share of a host's pages, and on so many of them at least.
SUPPORT = 0.6
MIN_PAGES = 3

# Fixed values of HTML: elements by what they are.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg"}
#: Without an end tag these reach to the end of the page; of the other raw elements only the tag goes.
RAW_TO_END = {"script", "style", "textarea", "title"}
NESTING = {"template", "svg"}
MATH = {
    "math", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts",
    "mprescripts", "none", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "menclose", "merror", "semantics", "annotation", "annotation-xml",
}
#: Elements that a trailing slash ends.
SLASH_ENDS = {"svg", "path", "circle"} | MATH
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "object", "canvas",
} | MATH
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"} | RAW
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words that mark what is not the article: a class or id counts if all its words are of these.
LEFT_OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe",
    "comment", "comments", "reply", "replies", "respond", "disqus", "related", "share", "sharing", "social", "toolbar", "pagination", "pager", "widget", "login", "signup",
}
ARTICLE = {"article", "main"}
ARTICLE_ROLES = {"main", "article"}
#: Closing one of the values' elements is implied where the key starts.
ENDS_PARAGRAPH = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "aside", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote", "address", "figure", "fieldset", "details"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot"}

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PARTS = re.compile(r"[^\W\d_]+")
BLANK = re.compile(r"\s+")


def _left_out(name: str, attributes: dict[str, str]) -> bool:
    """Left out by what the element is."""
    return name in LEFT_OUT or attributes.get("role", "").lower() in LEFT_OUT_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"


def _named_out(name: str, attributes: dict[str, str]) -> bool:
    """Left out by a class or id, which only counts as a whole: `cookie-notice`, not `notice-period`."""
    if name in ("html", "body"):
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    return any(words and LEFT_OUT_WORDS.issuperset(words) for words in (PARTS.findall(n) for n in named.split()))


def _raw_ends(page: str, name: str) -> dict[int, int]:
    """Ends of the elements of a raw name that have an end tag, by their start."""
    out, opened = {}, []
    for tag in re.finditer(rf"<(/?){name}(?=[\s/>]|$)[^>]*(?:>|$)", page, re.I):
        if tag.group(1):
            if opened:
                out[opened.pop()] = tag.end()
        elif not opened or name in NESTING and not tag.group().endswith("/>"):
            opened.append(tag.start())
    return out


class Token:
    __slots__ = ("kind", "name", "text", "path", "article", "left_out", "named", "block")

    def __init__(self, kind: str, name: str, text: str, path: str, article: int, left_out: bool, named: tuple[int, ...], block: bool):
        self.kind, self.name, self.text, self.path, self.article, self.left_out, self.named, self.block = kind, name, text, path, article, left_out, named, block


def tokens_of(page: str) -> list[Token]:
    """Tokens of a page in order. Elements that are not closed end where their parent ends; a
    paragraph ends where the next block starts. The numbers in `named` are those of the open elements
    that a class or id leaves out; an element that holds an article is none of them."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool, int, tuple[int, ...]]] = []  # name, label, left out, article number, named
    holders: set[int] = set()
    elements = 0
    raw_ends: dict[str, dict[int, int]] = {}
    articles, at = 0, 0

    def state() -> tuple[str, int, bool, tuple[int, ...]]:
        return (stack[-1][1], stack[-1][3], stack[-1][2], stack[-1][4]) if stack else ("", 0, False, ())

    def say(text: str) -> None:
        if text:
            path, article, left, named = state()
            out.append(Token("text", "", html_module.unescape(text), path, article, left, named, False))

    def close(names: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    name, path, left, article, named = stack.pop()
                    out.append(Token("end", name, "", path, article, left, named, name not in INLINE))
                return
            if stack[k][0] in scope:
                return

    while True:
        match = TAG.search(page, at)
        say(page[at : match.start() if match else len(page)])
        if not match:
            break
        at = match.end()
        closing, name = match.group(1), (match.group(2) or "").lower()
        if not name:
            continue
        if closing:
            close({name}, set() if name in ENDS_PARAGRAPH | {"body", "html"} else {"article", "main", "body"})
            continue
        attributes = {m[0].lower(): html_module.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(match.group(3) or "")}
        if "hidden" in (match.group(3) or "").lower() and re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub(" ", match.group(3)), re.I):
            attributes["hidden"] = ""
        if name in ENDS_PARAGRAPH:
            close({"p"}, {"td", "th", "li", "div", "article", "section", "main", "body", "button", "aside", "blockquote", "figure", "form"})
        elif name in SAME_ENDS:
            close(SAME_ENDS[name], SCOPES)
        path, article, left, named = state()
        label = f"{name}.{attributes.get('class', '')}#{attributes.get('id', '')}"
        left = left or _left_out(name, attributes)
        by_name = _named_out(name, attributes)
        if not left and not article and (name in ARTICLE or attributes.get("role", "").lower() in ARTICLE_ROLES):
            articles += 1
            article = articles
            if not by_name:
                holders.update(named)
                named = ()
        if by_name:
            elements += 1
            named = (*named, elements)
        # the path leaves out inline elements, so that an unclosed one does not change what follows
        inner = path if name in INLINE else f"{path}/{label}"[-200:]
        out.append(Token("start", name, "", inner, article, left, named, name not in INLINE))
        if name in VOID or name in SLASH_ENDS and (match.group(3) or "").rstrip().endswith("/"):
            continue
        if name in RAW:
            if name in RAW_TO_END:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                if name not in raw_ends:
                    raw_ends[name] = _raw_ends(page, name)
                at = max(at, raw_ends[name].get(match.start(), at))
            continue
        stack.append((name, inner, left, article, named))
    if holders:
        for token in out:
            if token.named:
                token.named = tuple(k for k in token.named if k not in holders)
    return out


def token_key(token: Token) -> int:
    text = BLANK.sub(" ", token.text).strip() if token.kind == "text" else ""
    return xxhash.xxh3_64_intdigest(f"{token.kind}\0{token.name}\0{token.path}\0{text}".encode(errors="replace"))


def page_keys(tokens: list[Token]) -> list[int | None]:
    """Keys of the tokens; blank text has none."""
    return [None if t.kind == "text" and not t.text.strip() else token_key(t) for t in tokens]


def _taken(tokens: list[Token], keys: list[int | None], template: set[int]) -> list[bool]:
    """Of each token, whether it is text of the article."""
    slot, slots, named_sizes = 0, [], Counter()
    in_articles, shared, outside = 0, 0, Counter()
    has_article = False
    for token, key in zip(tokens, keys, strict=True):
        has_article = has_article or bool(token.article and not token.named)
        if key in template:
            slot += 1
        slots.append(slot)
        if token.kind != "text" or token.left_out or key is None:
            continue
        size = len(token.text.strip())
        if key in template:
            shared += size if token.article and not token.named else 0
        elif token.named:
            named_sizes[token.named[0]] += size
        elif token.article:
            in_articles += size
        else:
            outside[slot] += size
    # an article that is for the most part template is one that several pages hold: it stays whole
    whole = shared > in_articles
    in_articles += shared if whole else 0
    # without a template the whole page is one slot, of which an article is taken
    large = {k for k, n in outside.items() if not has_article or template and n > in_articles}
    size = in_articles + sum(outside[k] for k in large)
    freed = {k for k, n in named_sizes.items() if n > size} if template and not (has_article and size) else set()
    return [
        t.kind == "text" and not t.left_out and (key not in template or whole and bool(t.article) and not t.named)
        and (t.named[0] in freed if t.named else bool(t.article) or slot in large)
        for t, key, slot in zip(tokens, keys, slots, strict=True)
    ]


def main_text(tokens: list[Token], keys: list[int | None], template: set[int]) -> str:
    """Text of the slots, blocks joined by line breaks; of several articles, all are taken."""
    blocks, parts = [], []

    def flush() -> None:
        text = BLANK.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(text)
        parts.clear()

    for token, taken in zip(tokens, _taken(tokens, keys, template), strict=True):
        if taken:
            parts.append(token.text)
        elif token.block:
            flush()
    flush()
    return "\n".join(blocks)


def host_of(url):
    """Host of a URL column in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][-+.\w]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: Stands for the page itself among its tokens.
PAGE_TOKEN = 0


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: a hash of its text and one of all its tokens; of each token its count and its
    first place among the page's tokens."""
    for batch in batches:
        contents, variants, keys, first, counts = [], [], [], [], []
        for page in texts(batch.column(1)):
            tokens = tokens_of((page or b"").decode(errors="replace"))
            found = page_keys(tokens)
            place: dict[int, int] = {PAGE_TOKEN: -1}
            for i, k in enumerate(found):
                if k is not None:
                    place.setdefault(k, i)
            times = Counter(k for k in found if k is not None)
            times[PAGE_TOKEN] = 1
            said = [k for k, t in zip(found, tokens, strict=True) if k is not None and t.kind == "text" and not t.left_out]
            contents.append(xxhash.xxh3_64_intdigest(np.array(said, dtype=np.uint64).tobytes()))
            variants.append(xxhash.xxh3_64_intdigest(np.array([k for k in found if k is not None], dtype=np.uint64).tobytes()))
            keys.append(signed(np.array(list(place), dtype=np.uint64)))
            counts.append(np.array([times[k] for k in place], dtype=np.int32))
            first.append(np.array(list(place.values()), dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(signed(np.array(contents, dtype=np.uint64)), pa.int64()), pa.array(signed(np.array(variants, dtype=np.uint64)), pa.int64()),
                lists(keys, pa.int64()), lists(counts, pa.int32()), lists(first, pa.int32()),
            ],
            ["host", "content", "variant", "token", "times", "place"],
        )


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, classes, shared): tokens of the host's template in order, the class of each,
    and whether different pages share it.

    A vector's hash adds up hashes of (page, count) by exclusive or. Pages with the same text are
    reduced to one, which stands for as many rows; a token that is on most rows delimits slots, but
    only one that is also on MIN_PAGES different texts and SUPPORT of them is shared. A token on
    SUPPORT of the pages has at most 1 / SUPPORT times the tokens of an average page beside it, so a
    host's template is no longer than that, whatever the number of pages."""
    hosted = pages.select(host_of(F.col("url")).alias("host"), "html")
    each = hosted.mapInArrow(_evidence, "host string, content long, variant long, token array<long>, times array<int>, place array<int>")
    different = each.groupBy("host", "content").agg(F.count("*").alias("rows"), F.min(F.struct("variant", "token", "times", "place")).alias("p"))
    rows = different.select("host", "content", "rows", F.explode(F.arrays_zip("p.token", "p.times", "p.place")).alias("t")).select("host", "content", "rows", "t.*")
    vectors = rows.groupBy("host", "token").agg(
        F.sum("rows").alias("on"), F.count("*").alias("contents"), F.bit_xor(F.xxhash64("content", "times")).alias("vector"), F.max("times").alias("most"), F.avg("place").alias("place"),
    )
    often = kept(vectors.where(F.col("on") >= MIN_PAGES), "vectors")
    sizes = often.where(F.col("token") == PAGE_TOKEN).select("host", F.col("on").alias("pages"), F.col("contents").alias("texts"))
    shared = (F.col("contents") >= MIN_PAGES) & (F.col("contents") >= SUPPORT * F.col("texts"))
    of_rows = F.col("on") >= SUPPORT * F.col("pages")
    frequent = often.where(F.col("token") != PAGE_TOKEN).join(sizes, "host").withColumn("shared", shared).where((of_rows | F.col("shared")) & (F.col("most") == 1))
    return frequent.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "token", "vector", "shared"))).alias("t")).select(
        "host", F.transform("t", lambda t: t["token"]).alias("tokens"), F.transform("t", lambda t: t["vector"]).alias("classes"),
        F.transform("t", lambda t: t["shared"]).alias("shared"),
    )


def nested(tokens: list[int], classes: list[int], keys: list[int | None]) -> set[int]:
    """Template tokens on a page: those of valid classes. A class is valid on a page that has all
    its tokens in the template's order; of classes that overlap without nesting the later goes."""
    place = {k: i for i, k in enumerate(keys) if k is not None}
    members: dict[int, list[int]] = {}
    for token, of in zip(tokens, classes, strict=True):
        members.setdefault(of, []).append(token & 0xFFFFFFFFFFFFFFFF)
    spans, out = [], set()
    for group in members.values():
        at = [place.get(t, -1) for t in group]
        if min(at) < 0 or any(a > b for a, b in zip(at, at[1:])):
            continue
        low, high = at[0], at[-1]
        if any(low < a < high < b or a < low < b < high for a, b in spans):
            # crossing spans nest if the one lies between two neighbours of the other
            if not any(set(at).isdisjoint(range(a, b + 1)) for a, b in spans):
                continue
        spans.append((low, high))
        out.update(group)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [None if t is None else zlib.compress(t, 3) for t in texts(batch.column(3))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["page_id", "url", "host", "packed"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for packed, *of_host in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            found = tokens_of(zlib.decompress(packed).decode(errors="replace")) if packed else []
            keys = page_keys(found)
            tokens, classes, shared = (x or [] for x in of_host)
            own = {t & 0xFFFFFFFFFFFFFFFF for t, s in zip(tokens, shared, strict=True) if not s}
            out.append(main_text(found, keys, nested(tokens, classes, keys) - own))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html).

    Null and empty html has an empty text. Pages without a host share one template; hosts of fewer
    than MIN_PAGES pages have none, and their pages go by elements alone. Other columns are
    ignored."""
    templates = kept(host_templates(pages), "templates")
    packed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(_packed, "page_id long, url string, host string, packed binary")
    joined = packed.join(templates, "host", "left").select("page_id", "url", "packed", "tokens", "classes", "shared")
    out = joined.mapInArrow(_extracted, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
