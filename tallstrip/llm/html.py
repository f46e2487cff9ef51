"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: each container element is a path of presentation (tags and classes). How it
is presented (the sequences of child elements) has an entropy over the pages that have it, and so has each single feature
of its own content (a block's text, a link's or picture's target). A leaf's importance says how unevenly its features are
spread over the pages; an inner element's combines the entropy of its presentations with the importance of what it is made
of, up the tree. What hardly varies although the host's pages do is of low importance, and its branches are removed from
each page. Elements whose presentation says what they are (menus, footers, adverts and the like) have none to begin with:
what they show may vary, and a host may have too few pages for a tree.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import discard, settle

#: Element names and class words, as HTML and common style sheets use them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
NEVER = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "audio", "video", "map"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"body", "div", "section", "main", "article", "header", "footer", "nav", "aside", "form", "menu", "dialog", "fieldset", "table", "ul", "ol", "dl", "center", "td", "tr", "tbody", "figure", "details"}
BOILERPLATE_WORDS = {"ad", "ads", "advert", "advertising", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "related", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Of these, the ones that say what the element is even where an article stands inside it.
FIRM_WORDS = {"comment", "comments", "disqus", "related", "respond"}
#: Parts of names that say where or in what shape something stands, not what it is.
PLAIN_WORDS = {"area", "articles", "aside", "bar", "block", "body", "bottom", "box", "buttons", "col", "column", "container", "content", "count", "desktop", "fixed", "form", "global", "group", "holder", "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "small", "stories", "text", "thread", "top", "unit", "wrap", "wrapper"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "alert", "dialog", "menu", "menubar", "toolbar", "form"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "hr", "address", "fieldset", "details"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

#: Attributes that say where a link leads or a picture comes from.
TARGETS = {"a": "href", "img": "src"}

#: Paths of low importance up to which the trees are broadcast; more are joined by host and salt.
BROADCAST_PATHS, SALTS = 200_000, 64

#: What an opening tag may end by itself.
CLOSERS = set().union(*CLOSED_BY.values())

_name = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_stop = re.compile(r"[>\"']")
#: Where an element without mark-up inside ends.
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}
_attribute = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Params:
    """pages: a path is judged if so many of a host's pages have it. importance: a path is removed below this share of the
    host's greatest. damping: the weight of what content says beside the presentation, to the power of how many
    presentations there are; the more there are, the more these alone show that the place varies."""

    pages: int = 8
    importance: float = 0.1
    damping: float = 0.9


#: How surely an element's presentation says boilerplate: not at all; unless an article stands inside; in any case.
OPEN, SOFT, FIRM = 0, 1, 2


def _said(names: str, in_article: bool) -> set[str]:
    """The boilerplate words among an element's names. A name counts as a whole: all its parts are such words, or say no
    more than place and shape. So "site-footer" is a footer, and neither "social-history" nor "banner-story" anything."""
    found = set()
    for name in names.split():
        parts = {m.lower() for m in _word.findall(name)}
        kinds = parts & (BOILERPLATE_WORDS if in_article else BOILERPLATE_WORDS | {"header"})
        if kinds and parts <= kinds | PLAIN_WORDS:
            found |= kinds
    return found


def _prior(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """How surely the presentation alone says boilerplate, and the element's name in paths."""
    if tag in NEVER:
        return FIRM, tag
    mark, name = SOFT if tag == "header" and not in_article else OPEN, tag
    if attributes and not attributes.isspace():
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)}
        name = f"{tag}.{values['class'].lower()}" if values.get("class") else f"{tag}#{values['id'].lower()}" if values.get("id") else tag
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").lower().replace(" ", ""):
            return FIRM, name
        said = _said(f"{values.get('class', '')} {values.get('id', '')}", in_article)
        if tag not in ("html", "body"):
            if FIRM_WORDS & said and (tag not in ("article", "main") or said & {"comment", "comments"}):
                return FIRM, name
            if values.get("role", "").lower() in ROLES or tag not in ("article", "main") and said:
                return max(mark, SOFT), name
    return mark, name


class Path:
    """A container in its page. The key is its tag and a hash chained over its own and its ancestors' names, as short at
    any depth. Of its child elements it keeps a running hash."""

    __slots__ = ("above", "key", "shown")

    def __init__(self, above: Path | None, tag: str, name: str):
        self.above = above
        self.key = f"{tag}:{hashlib.blake2b(f'{above.key if above else ""}/{name}'.encode('utf-8', 'replace'), digest_size=12).hexdigest()}"
        self.shown = None

    def show(self, name: str) -> None:
        self.shown = self.shown or hashlib.blake2b(digest_size=8)
        self.shown.update(name.encode("utf-8", "replace") + b"\0")


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag; comments and declarations have no name. A raw
    element (a script, a style sheet) is one item up to the end of its closing tag, whatever it holds. A "<" that no tag
    follows is text. Each character is looked at a bounded number of times, however the mark-up is broken."""
    at, size, last, plain = 0, len(page), page.rfind(">"), False
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = size if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        if start > last:
            return
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            yield start, at, False, "", ""
            continue
        m = _name.match(page, start)
        if m is None:
            continue
        end = m.end()
        while not plain:
            stop = _stop.search(page, end)
            if stop is None:
                end = -1
            elif stop[0] == ">":
                end = stop.start()
            else:
                if page[end : stop.start()].rstrip()[-1:] != "=":  # only a value may be quoted
                    end = stop.end()
                    continue
                end = page.find(stop[0], stop.end()) + 1 or -1
                if end > 0:
                    continue
            break
        if plain:
            end = page.find(">", end)
        if end < 0:  # a quote that nothing closes; from here on tags end at the next ">", quoted or not
            plain = True
            continue
        at, name, closes = end + 1, m[1].lower(), page[start + 1] == "/"
        if name in RAW and not closes:
            behind = _raw_end[name].search(page, at)
            at = behind.end() if behind else size
        yield start, at, closes, name, page[m.end() : end]


def walk(page: str, closed: Callable[[Path], None] | None = None, linked: Callable[[Path | None, str], None] | None = None) -> Iterator[tuple[Path | None, bool, bool, str]]:
    """(container path, boilerplate by presentation, inside article or main, text) of each text; a block's start and
    end give a text of one space. closed: told of each container when it ends, inner ones first; linked: of the targets of
    links and pictures."""
    stack: list[tuple[str, Path | None, int, bool]] = []  # tag, path, boilerplate, in article
    open_, path, bad, inside, at = Counter(), None, OPEN, False, 0

    def cut(i: int) -> None:
        for k in range(len(stack) - 1, i - 1, -1):
            tag, own = stack[k][:2]
            open_[tag] -= 1
            if closed and own and tag in CONTAINERS:
                closed(own)
        del stack[i:]

    for start, end, closes, tag, attributes in tags(page):
        if start > at:
            yield path, bad > OPEN, inside, page[at:start]
        at = end
        if not tag:
            continue
        if tag in BLOCKS:
            yield path, bad > OPEN, inside, " "
        if closes:
            if open_[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                cut(i)
            _, path, bad, inside = stack[-1] if stack else ("", None, OPEN, False)
            continue
        if tag in CLOSERS and any(open_[x] > 0 for x in CLOSED_BY):  # an unclosed inline element doesn't keep a paragraph or item open
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSED_BY:
                    if tag in CLOSED_BY[stack[i][0]]:
                        cut(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        _, path, bad, inside = stack[-1] if stack else ("", None, OPEN, False)
        if linked and tag in TARGETS:
            for m in _attribute.finditer(attributes):
                if m[1].lower() == TARGETS[tag]:
                    linked(path, m[2] or m[3] or m[4] or "")
                    break
        if tag in VOID or tag in RAW or attributes.endswith("/") and tag not in BLOCKS:
            continue
        mark, name = _prior(tag, attributes, inside)
        if path and tag in BLOCKS:
            path.show(name)
        path = Path(path, tag, name) if tag in CONTAINERS else path
        if tag in ("article", "main"):
            inside, bad = True, OPEN if bad == SOFT else bad
        bad = max(bad, mark)
        stack.append((tag, path, bad, inside))
        open_[tag] += 1
    if at < len(page):
        yield path, bad > OPEN, inside, page[at:]
    cut(0)


def _digest(data: str) -> str:
    return hashlib.blake2b(data.encode("utf-8", "replace"), digest_size=8).hexdigest()


def nodes(page: str) -> dict[str, tuple[str, str, Counter]]:
    """By container path: the path above it, a digest of its child elements, and how often it has each feature of its own,
    which are the texts of its blocks and the targets of its links. What containers inside it hold is theirs."""
    found: dict[str, tuple] = {}
    held: dict[str, Counter] = {}

    def has(path: Path | None, feature: str) -> None:
        if path:
            held.setdefault(path.key, Counter())[_digest(feature)] += 1

    def closed(path: Path) -> None:
        found.setdefault(path.key, (path.above.key if path.above else "", hashlib.blake2b(digest_size=8)))[1].update((path.shown.digest() if path.shown else b"") + b"\0")

    at, said = None, []

    def flush() -> None:
        if at and (text := " ".join("".join(said).split())):
            has(at, "t" + text)
        said.clear()

    for path, _, _, text in walk(page, closed, lambda path, target: has(path, "l" + target)):
        if path is not at or text == " ":
            flush()
            at = path
        said.append(text)
    flush()
    return {key: (above, shown.hexdigest(), held.get(key, Counter())) for key, (above, shown) in found.items()}


def _under(path: Path | None, low: frozenset[str], known: dict[Path, bool]) -> bool:
    """Whether the path or one above it is low."""
    new = []
    while path and path not in known:
        new.append(path)
        path = path.above
    found = bool(path) and known[path]
    for p in reversed(new):
        known[p] = found = found or p.key in low
    return found


def extract(page: str, low: frozenset[str] = frozenset()) -> str:
    """The page's main text: its articles' if it has any, else all its body's, without what is boilerplate."""
    every, articles, known = [], [], {}
    for path, bad, inside, text in walk(page):
        if bad or low and _under(path, low, known):
            continue
        every.append(text)
        if inside:
            articles.append(text)
    picked = articles if any(not t.isspace() for t in articles) else every
    return " ".join(html.unescape("".join(picked)).split())


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


_ROWS = "host string, path string, above string, own boolean, digest string, n bigint"


def importances(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """(host, path, importance) of the paths that enough pages have. rows: for each page and path one of (host, path, the
    path above, whether it has features of its own, digest of its presentation, null), and for each of its features one of
    (host, path, null, null, digest, how often).

    A presentation's or feature's entropy is taken over the m pages that have the path, to the base m, so it lies between 0
    and 1. Content's importance is one less the mean entropy of its features, each counted as often as it occurs: 0 if all
    stand on all pages alike, 1 if each stands on one page alone. With l presentations of entropy N, and the importance I of content and of the paths below,
    averaged by how many pages have each, a path's importance is (1 - damping ** l) * N + damping ** l * I; paths below
    that too few pages have count as 1. Importances are added up the tree in as many rounds as its depth has binary digits.
    Equal rows are counted before they meet, so a host of any size is summed up first.
    """
    each = rows.groupBy("host", "path", "digest", F.col("n").isNull().alias("shape")).agg(F.count("*").alias("pages"), F.count_if("own").alias("own"), F.max("above").alias("above"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    shape = F.col("shape")
    spread = F.col("n") * F.log("n") - F.col("nlogn")  # a feature's entropy, to the natural base, as often as it occurs
    sums = each.groupBy("host", "path").agg(
        F.sum(F.when(shape, F.col("pages"))).alias("m"), F.sum(F.when(shape, F.col("own"))).alias("own"), F.max("above").alias("above"), F.count_if(shape).alias("l"),
        F.sum(F.when(shape, F.col("pages") * F.log("pages"))).alias("shapes"), F.coalesce(F.sum(F.when(~shape, F.col("n"))), F.lit(0)).alias("features"), F.sum(F.when(~shape, spread)).alias("spread"),
    )
    sums = settle(sums, "paths")
    below = sums.groupBy("host", F.col("above").alias("path")).agg(F.sum("m").alias("below"), F.sum(F.when(F.col("m") < params.pages, F.col("m")).otherwise(0)).alias("few"))
    enough = sums.where(F.col("m") >= params.pages).join(below, ["host", "path"], "left").withColumns({"below": F.coalesce("below", F.lit(0)), "few": F.coalesce("few", F.lit(0))})
    weight = F.pow(F.lit(params.damping), F.col("l"))
    whole = F.greatest(F.col("own") + F.col("below"), F.lit(1))
    shown = F.when(F.col("l") > 1, F.greatest(F.lit(0.0), 1 - F.col("shapes") / (F.col("m") * F.log("m")))).otherwise(0.0)
    content = F.when(F.col("features") > 0, F.greatest(F.lit(0.0), 1 - F.col("spread") / (F.col("features") * F.log("m")))).otherwise(0.0)
    state = enough.select("host", "path", F.col("above").alias("up"), F.col("m"), (weight / whole).alias("share"), ((1 - weight) * shown + weight * (F.col("own") * content + F.col("few")) / whole).alias("importance"))
    parents = state.select("host", F.col("path").alias("up"), F.col("share").alias("of"))
    joined = state.join(parents, ["host", "up"], "left").select("host", "path", F.when(F.col("of").isNotNull(), F.col("up")).alias("up"), (F.col("m") * F.col("of")).alias("w"), "importance")
    state = settle(joined, "importances")
    while not state.where("up IS NOT NULL").isEmpty():
        given = state.where("up IS NOT NULL").groupBy("host", F.col("up").alias("path")).agg(F.sum(F.col("w") * F.col("importance")).alias("more"))
        ahead = state.select("host", F.col("path").alias("up"), F.col("up").alias("up2"), F.col("w").alias("w2"))
        after = state.join(given, ["host", "path"], "left").join(ahead, ["host", "up"], "left")
        after = settle(after.select("host", "path", F.col("up2").alias("up"), (F.col("w") * F.col("w2")).alias("w"), (F.col("importance") + F.coalesce("more", F.lit(0.0))).alias("importance")), "importances")
        discard(state)
        state = after
    discard(sums)
    return state.select("host", "path", "importance")


def style_tree(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(host, low): the container paths of low importance in each host that has any. Importance is compared with the
    greatest of the host: where pages are copies of each other, nothing is removed for that. Body, article and main stay."""

    def work(frames):
        for frame in frames:
            rows = []
            for host, page in frame.itertuples(index=False):
                for path, (above, shown, features) in nodes(page if isinstance(page, str) else "").items():
                    rows.append((host, path, above, bool(features), shown, None))
                    rows += [(host, path, None, None, digest, n) for digest, n in features.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "above", "own", "digest", "n"]).astype({"n": "Int64", "own": "boolean"})

    found = importances(pages.select("host", "html").mapInPandas(work, _ROWS), params)
    whole = found.withColumn("whole", F.max("importance").over(Window.partitionBy("host")))
    tag = F.regexp_extract("path", r"^([a-z0-9]+)", 1)
    low = whole.where((F.col("whole") > 0) & (F.col("importance") < params.importance * F.col("whole")) & ~tag.isin("body", "article", "main"))
    return low.groupBy("host").agg(F.collect_list("path").alias("low"))


def main_text(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(page_id, url, text, n_chars) per row of (page_id, url, html).

    A null or empty html gives an empty text; a null or malformed url belongs to the host ""; repeated rows stay, and
    count as pages of their host. Truncated or badly nested mark-up is read as far as it goes. No pages: no rows.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"), host_of(F.col("url")).alias("host"))
    trees = settle(style_tree(rows, params), "trees")
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(frames):
        for frame in frames:
            low = [frozenset(x) if x is not None else frozenset() for x in frame["low"]]
            texts = [extract(page if isinstance(page, str) else "", x) for page, x in zip(frame["html"], low, strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    if trees.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_PATHS:
        met = rows.join(F.broadcast(trees), "host", "left")
    else:  # a host's pages are dealt by salt, and its tree goes to each
        salted = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = met.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "low")
    out = joined.mapInPandas(work, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast(kind))
