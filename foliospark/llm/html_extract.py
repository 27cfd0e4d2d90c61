"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; a linear scan finds the contiguous region
of highest score. Weights are log odds of a token's kind inside against outside the content of labelled pages: pages that
mark their content themselves (article or main elements) label it for the others. On those pages, too, the scan decides:
crossing the bound of such an element only costs score, and words outside count less. What is never content (menus,
adverts, forms, comments and the like, known by element, role or class) is left out of the sequence first. A class or a form
may also be that of a frame around everything: where leaving such elements out leaves no content element, those that hold one
are read after all, and where there is none at all, one that holds most of the page's words.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 2_000  # pages that weights are learnt from, those of smallest hash
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Fixed values of HTML: elements whose text isn't parsed, elements without an end, and elements that begin a block.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
INLINE = set("a abbr acronym audio b bdi bdo big cite code data datalist del dfn em font i ins kbd label map mark meter nobr option optgroup output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var video".split())
CONTENT = {"article", "main"}
#: An end tag within one of these doesn't end what was open around it.
SCOPE = {"article", "main", "body", "table"}
CROSSING = {"article", "main", "body", "html"}  # end tags that do
BOUND = -50.0  # score of leaving a content element, and of entering the outermost: what lies beyond must outweigh it
OUTSIDE = 0.5  # factor of a word's score outside all content elements of a page that has some
#: Elements, roles and words of class or id that are never content.
SKIP = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "head", "label", "option"}
SKIP_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog"}
SKIP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar",
    "widget", "widgets", "login", "search", "alert", "copyright", "recommended", "responses", "discussion",
}
HEADER_WORDS = {"header"}
COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "reply", "respond", "responses", "discussion"}
#: How an element is left out: for good, or unless it is a frame, of which that of comments needs a content element.
NEVER, FRAME, COMMENTS = 1, 2, 3
PASSES = 10  # frames within frames
KNOWN = RAW | VOID | BLOCK | INLINE | SKIP
#: Elements whose end tags are often left out: a new one ends an open one of the same set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _skipped(name: str, attributes: str, in_content: bool) -> int:
    """Whether an element is never content: NEVER, FRAME or COMMENTS, else 0."""
    if name in SKIP or name == "header" and not in_content:
        return FRAME if name == "form" else NEVER
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    found = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in SKIP_ROLES or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) or re.search(r"display\s*:\s*none", found.get("style", "")):
        return NEVER
    names = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if name in CONTENT or name in ("body", "html"):
        return NEVER if names & {"comment", "comments", "reply", "respond"} and name == "article" else 0
    if names & SKIP_WORDS or names & HEADER_WORDS and not in_content:
        return COMMENTS if names & COMMENT_WORDS else FRAME
    return 0


def parse(page: str) -> tuple[list[tuple[str, int, bool]], list[str]]:
    """(sequence, blocks) of a page, with frames that must be read after all."""
    frames: set[int] = set()
    for _ in range(PASSES):
        seq, blocks, left_out = _parsed(page, frames)
        if any(c and b >= 0 for _, b, c in seq):
            break
        more = {at for at, _, _, holds in left_out if holds}
        if not more and not any(holds for *_, holds in left_out):
            most = sum(len(x.split()) for x in blocks) + sum(n for _, _, n, _ in left_out)
            more = {at for at, kind, n, _ in left_out if kind == FRAME and 2 * n > most}
        if not more:
            break
        frames |= more
    return seq, blocks


def _parsed(page: str, frames: set[int]) -> tuple[list[tuple[str, int, bool]], list[str], list[tuple[int, int, int, bool]]]:
    """(sequence, blocks, left out): the page's tokens outside what is skipped, the texts of its blocks, and the outermost elements that were
    skipped but may be frames: (place, kind, words, whether a content element with words is in it). Elements at the places `frames` aren't skipped.

    A token is (kind, block, in content): kind is a tag that begins ('<p>' as 'p', one that HTML doesn't know as 'other'), '/' for a bound of a content element
    (the end of each, and the begin of an outermost one), or 'word' or 'linked' with as many tokens as the block has
    words. in content: within an article or main element. A text without a place yet, white space alone, makes no block.
    """
    seq: list[tuple[str, int, bool]] = []
    blocks: list[str] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []
    left_out: list[list] = []
    opened: list[Counter] = [Counter()]  # names of open elements, by scope; an end tag without a begin looks no further
    every: Counter = Counter()
    skip = content = links = never = 0

    def flush() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, a in parts if a)
            n = len(text.split())
            seq.extend([("linked", len(blocks), content > 0)] * min(linked, n) + [("word", len(blocks), content > 0)] * max(0, n - linked))
            blocks.append(text)
        parts.clear()

    def pop(to: int) -> None:
        nonlocal skip, content, links, never
        while len(stack) > to:
            name, was = stack.pop()
            opened[-1][name] -= 1
            every[name] -= 1
            if name in SCOPE:
                opened.pop()
            if name in CONTENT:
                if not skip:
                    seq.append(("/", -1, True))
                content -= 1
            skip -= was > 0
            never -= was == NEVER
            links -= name == "a"

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not skip:
            parts.append((entities.unescape(text), links > 0))
        elif text and not never:
            n = len(text.split())
            left_out[-1][2] += n
            left_out[-1][3] |= n > 0 and content > 0
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in RAW and not m[3].rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in BLOCK:
            flush()
        elif name == "br" and not skip:
            parts.append((" ", False))
        if not skip and not closing:
            seq.append((name if name in KNOWN else "other", -1, content > 0))
        if closing:
            if (every if name in CROSSING else opened[-1])[name]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            ends = CLOSES.get(name, {"p"} if name in BLOCK else set())
            while stack and stack[-1][0] not in BLOCK and ends and any(x in ends for x, _ in stack[-6:]):
                pop(len(stack) - 1)
            if stack and stack[-1][0] in ends:
                pop(len(stack) - 1)
            was = 0 if m.start() in frames else _skipped(name, m[3], content > 0)
            if name in SCOPE:
                opened.append(Counter())
            stack.append((name, was))
            opened[-1][name] += 1
            every[name] += 1
            if was > NEVER and not skip:
                left_out.append([m.start(), was, 0, False])
            skip += was > 0
            never += was == NEVER
            if name in CONTENT:
                if not skip and not content:
                    seq.append(("/", -1, False))
                content += 1
            links += name == "a"
    flush()
    return seq, blocks, [tuple(x) for x in left_out]


def count_labelled(page: str) -> tuple[Counter, Counter]:
    """Kinds of tokens inside and outside the content of a page that marks it; both empty for others."""
    seq = [(k, c) for k, _, c in parse(page)[0] if k != "/"]
    inside = Counter(k for k, c in seq if c)
    return (inside, Counter(k for k, c in seq if not c)) if inside["word"] else (Counter(), Counter())


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Score by kind: a word's is positive and a tag's negative, larger the rarer the tag is where the content is."""
    n, m = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {k: math.log(((inside[k] + 0.5) / n) / ((outside[k] + 0.5) / m)) for k in {*inside, *outside}}
    out = {k: min(-0.1, max(-3.0, v - 0.5)) for k, v in odds.items() if k not in ("word", "linked")}
    return out | {"word": min(1.0, max(0.5, odds.get("word", 0.5))), "linked": min(-0.1, max(-1.0, odds.get("linked", -0.5) - 0.5))}


def best_region(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run of highest sum, the longest of equals' first; (0, 0) if no sum is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The main text of a page: its blocks in the best region, joined by \\n."""
    seq, blocks = parse(page or "")
    if not blocks:
        return ""
    marked = any(c and b >= 0 for _, b, c in seq)  # an element without words bounds nothing
    outside, bound = (OUTSIDE, BOUND) if marked else (1.0, 0.0)
    scores = [bound if k == "/" else weight.get(k, -0.5) * (outside if k == "word" and not c else 1.0) for k, _, c in seq]
    lo, hi = best_region(scores)
    taken = {b for _, b, _ in seq[lo:hi] if b >= 0}
    return "\n".join(x for b, x in enumerate(blocks) if b in taken)


def learn(pages: DataFrame, max_pages: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from the labelled ones among a bounded sample of pages; without any, from even counts."""
    marked = pages.filter(F.col("html").contains("<article") | F.col("html").contains("<main"))
    # hashes alone are sorted; pages that share the last hash (repeated ids) all belong to the sample
    last = marked.select(F.xxhash64("page_id").alias("h")).orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    sample = marked.filter(F.xxhash64("page_id") <= F.lit(last).cast("long")).select("html")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [Counter(), Counter()]
            for page in pdf["html"]:
                for total, got in zip(both, count_labelled(page)):
                    total.update(got)
            yield pd.DataFrame([(k, side == 0, n) for side in (0, 1) for k, n in both[side].items()], columns=["kind", "inside", "n"])

    got = sample.mapInPandas(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()  # at most two rows for each known tag
    return weights(Counter({r["kind"]: r["n"] for r in got if r["inside"]}), Counter({r["kind"]: r["n"] for r in got if not r["inside"]}))


def main_text(pages: DataFrame, max_pages: int = MAX_LABELLED) -> DataFrame:
    """Per row of pages: page_id, url, text (main text; empty if none), n_chars (its code points).

    Null html is empty. Repeated rows get equal texts; an empty table gives an empty result; broken markup is read as
    far as it goes; pages of any length are read whole, in time that grows with them. Of regions of equal score the first is taken. Other
    columns are ignored.
    """
    weight = learn(pages, max_pages)

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return pd.Series([extract(p, weight) for p in page], dtype=object)

    return pages.select("page_id", "url", text_of("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
