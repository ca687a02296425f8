"""Main text of web pages by consensus host paths.

First pass: each page's containers are scored by the plain text in them, less text in links and in boilerplate, and the
page's best container gives a vote, weighted by its share of the page's text, to its generalised path (tags with their
class words, figures removed). Votes are summed by host and path in Spark; each host's path with the most weight wins.
Second pass: every page is cut again with its host's winning path; a page that has no such container, or hardly any text
in it, keeps its own best one.

Null and empty pages, and pages without text, give an empty string. A null or unreadable url belongs to the host ''.
Ties between paths go to the longer, then the lexically smaller path; ties between containers to the earlier one. Each
row is cut on its own, repeated page_ids too; very long and deeply nested pages are cut whole, in time that grows with
their length. Columns other than page_id, url and html play no part.

What is around an article is known by its tags and class words, never by its size. Menus, footers, asides, comments,
related cards and notices are no part of any article, however long, and hold none: an ``<article>`` among comments is a
comment. Words that name a place in the layout (a form about the whole page, a body "with sidebar") may also name a
wrapper of the article; such an element is looked into where nothing outside of it is marked as the article.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table, with_columns

#: Hosts that may be broadcast with their paths; with more of them pages meet their host's path by a salted join.
BROADCAST_HOSTS = 50_000
SALTS = 32
#: A container by the host's path must hold this share of the text of the page's own best container.
LEAST_SHARE = 1 / 3

# Elements without content or end tag; elements whose content is no text; elements that end a block;
# elements and class or id words of what surrounds an article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea button".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_AROUND = frozenset("nav footer aside form header menu dialog".split())
# Of tags and words around an article, those that may also be about it.
_LAYOUT_TAGS = frozenset("form header".split())
_LAYOUT_WORDS = frozenset("header masthead sidebar side rail widget widgets banner ad ads promo promos form search social share sharing overlay modal tags footer foot".split())
_AROUND_WORDS = _LAYOUT_WORDS | frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs topbar bottombar aside related recommended recommendations promoted promotion advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup comment comments reply replies discussion respond disqus pagination pager tagcloud copyright legal disclaimer skip".split()
)
# Words of one reader's comment; an element named so is none of the article, whatever else it is named.
_COMMENT_WORDS = frozenset("comment reply respond disqus".split())
_ARTICLE_WORDS = frozenset("article post entry story content main body text".split())
_SCOPES = frozenset("article body table".split())
_CONTAINERS = frozenset("article main section div td body".split())
# An end of one of these tags is implied by the start of the others.
_CLOSES = {"p": _BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


# What the start of a tag closes: open elements whose end it implies.
_ENDED_BY: dict[str, set] = {}
for _open, _starts in _CLOSES.items():
    for _start in _starts:
        _ENDED_BY.setdefault(_start, set()).add(_open)


FIT, LAYOUT, APART = range(3)


def _fit_of(tag: str, words: set[str], in_article: bool) -> int:
    """Whether an element may hold the article (FIT), may do so if nothing else does (LAYOUT), or is apart from it."""
    if tag in ("body", "html", "main", ""):
        return FIT
    named = words & _AROUND_WORDS
    if tag == "article":
        return APART if words & _COMMENT_WORDS else FIT
    if tag in _AROUND:
        if tag == "header" and in_article:  # an article's own header holds its title
            return FIT
        return LAYOUT if tag in _LAYOUT_TAGS and not named - _LAYOUT_WORDS else APART
    if not named:
        return FIT
    about = not named - _LAYOUT_WORDS or words & _ARTICLE_WORDS and not words & _COMMENT_WORDS
    return LAYOUT if about else APART


class Node:
    __slots__ = ("tag", "step", "key", "parent", "unfit", "hidden", "around", "within", "marked", "pieces", "text", "linked", "in_article", "taken", "words")

    def __init__(self, tag, parent, attributes):
        self.tag, self.parent = tag, parent
        self.pieces: list = []  # strings, nodes, in page order
        self.text = self.linked = self.within = 0
        self.around = self.marked = self.taken = False
        found = {}
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                found[m[1].lower()] = html.unescape(m[2] or m[3] or m[4] or "")
        label = re.sub(r"\d+", "", found.get("class", "")).split()
        self.words = {w for x in (found.get("class", ""), found.get("id", ""), found.get("role", "")) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) if w}
        self.hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.unfit = _fit_of(tag, self.words, self.in_article)
        # A path is a chain of steps; it is compared by its key, and written out only for votes and equal keys.
        self.step = ".".join([tag, *sorted(set(label))]) if tag in _CONTAINERS or label else None
        before = parent.key if parent is not None else 0
        self.key = before if self.step is None else hash((before, self.step))

    @property
    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            if node.step is not None:
                steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


def key_of(path: str) -> int:
    key = 0
    for step in path.split(">"):
        key = hash((key, step))
    return key


def tokens(page: str):
    """(text, closing, name, attributes) for each tag with the text before it; the last has no name. A quote that is never
    closed makes tags end at the next '>' from there on. ``send`` takes the place to go on from."""
    at, text_from, n, quoted = 0, 0, len(page), True
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield page[text_from:at], False, None, "", end
            at = text_from = end
            continue
        m = _NAME.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        full = _QUOTED.match(page, m.end()) if m is not None and quoted else None
        if full is not None:
            end, attributes = full.end(), full[1]
        else:
            quoted = quoted and m is None
            end = page.find(">", at)
            if end < 0:
                break
            attributes, end = page[m.end() : end] if m is not None else "", end + 1
        moved = yield page[text_from:at], bool(m and m[1]), m[2].lower() if m is not None else None, attributes, end
        at = text_from = end if moved is None else moved
        if moved is not None:
            yield None  # what send() returns
    yield page[text_from:], False, None, "", n


def parse(page: str) -> list[Node]:
    """The page's elements in order, under a root; tolerant of ends that are missing or misplaced."""
    root = Node("", None, "")
    nodes, open_ = [root], [root]
    count: dict[str, int] = {}
    # Open elements by tag since the last one that ends of inline elements do not reach across.
    scopes: list[dict[str, int]] = [{}]
    endless: set[str] = set()  # tags of which no end follows any more

    def close(i):
        for node in reversed(open_[i:]):
            count[node.tag] -= 1
            if node.tag in _SCOPES:
                scopes.pop()
            scopes[-1][node.tag] -= 1
        del open_[i:]

    stream = tokens(page)
    for text, closing, tag, attributes, at in stream:
        if text:
            open_[-1].pieces.append(text)
        if tag is None:
            continue
        if closing:
            if count.get(tag) if tag in _BLOCK else scopes[-1].get(tag):
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag == tag:
                        close(i)
                        break
            if tag in _BLOCK:
                open_[-1].pieces.append(None)
            continue
        if tag in _SILENT:
            if not attributes.endswith("/") and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    stream.send(end.end())
                elif tag in ("script", "style"):
                    break
                else:
                    endless.add(tag)
            continue
        if tag in ("br", "hr"):
            open_[-1].pieces.append(None if tag == "hr" else " ")
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK and any(count.get(t) for t in _ENDED_BY.get(tag, ())):
            # An open paragraph (or item, or cell) ends here, with the inline elements in it.
            for i in range(len(open_) - 1, 0, -1):
                if tag in _CLOSES.get(open_[i].tag, ()):
                    close(i)
                    break
                if open_[i].tag in _BLOCK:
                    break
        node = Node(tag, open_[-1], attributes)
        nodes.append(node)
        open_[-1].pieces.append(node)
        if not attributes.endswith("/"):
            open_.append(node)
            count[tag] = count.get(tag, 0) + 1
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
            if tag in _SCOPES:
                scopes.append({})
    return nodes


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under ``node``, without what is around the article."""
    out: list[str] = []
    line: list[str] = []

    def end():
        if line:
            text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
            if text:
                out.append(text)
            line.clear()

    stack = [(iter(node.pieces), False)]
    while stack:
        pieces, is_block = stack[-1]
        for piece in pieces:
            if piece is None:
                end()
            elif isinstance(piece, str):
                line.append(piece)
            elif not piece.around:
                block = piece.tag in _BLOCK
                if block:
                    end()
                stack.append((iter(piece.pieces), block))
                break
        else:
            stack.pop()
            if is_block:
                end()
    end()
    return out


def weigh(nodes: list[Node]) -> None:
    """Counts characters of plain and of linked text in each element, without what is around the article in it, and says
    what each element lies within and whether an article is marked in it or about it."""
    for node in nodes:
        node.around = node.hidden or node.unfit != FIT
        own = APART if node.hidden else node.unfit
        node.within = own if node.parent is None else max(own, node.parent.within)
        node.marked = node.tag in ("article", "main", "h1") or node.parent is not None and node.parent.marked and node.parent.tag != "h1"
    for node in reversed(nodes):
        node.text += sum(len(p) for p in node.pieces if isinstance(p, str) and not p.isspace())
        if node.tag == "a":
            node.linked = node.text
        if node.parent is not None and not node.around:
            node.parent.text += node.text
            node.parent.linked += node.linked
            node.parent.marked = node.parent.marked or node.marked


def score(node: Node) -> float:
    """Plain text in the element; named articles count more, and wrappers with the same text less than what they wrap."""
    favour = 1.25 if node.tag in ("article", "main") else 1.1 if node.words & _ARTICLE_WORDS else 1.0
    return (node.text - 2 * node.linked) * favour


def _best_of(nodes: list[Node]) -> Node | None:
    best, most = None, 0.0
    for node in nodes:
        s = score(node)
        # An inner container takes over when it keeps all of the plain text, headings and leads included.
        if best is None or s > most or (s >= 0.9 * most and node.text - node.linked >= 0.99 * (best.text - best.linked)):
            best, most = node, s if best is None else max(s, most)
    return best


def best_container(nodes: list[Node]) -> Node:
    """The container of the article: among those outside of all that is around articles, or within the layout's elements
    where only these hold a marked article, or any text."""
    held = [n for n in nodes if n.text and (n.tag in _CONTAINERS or n is nodes[0])]
    outside = _best_of([n for n in held if n.within == FIT])
    if outside is None or not outside.marked:
        inside = _best_of([n for n in held if n.within == LAYOUT])
        if inside is not None and (outside is None or inside.marked):
            return inside
    return outside or nodes[0]


def _cut(page: str, path: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    weigh(nodes)
    own = best_container(nodes)
    chosen = [own]
    if path is not None and own.path != path:
        key, by_path = key_of(path), []
        for x in nodes[1:]:  # the outermost ones by the host's path
            x.taken = x.parent.taken
            if not x.taken and x.key == key and x.tag in _CONTAINERS and x.within <= own.within and x.text and x.path == path:
                x.taken = True
                by_path.append(x)
        if own.text and sum(x.text for x in by_path) >= LEAST_SHARE * own.text:
            chosen = by_path
    return "\n".join(b for x in chosen for b in blocks(x))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host's pages."""

    def run(batches):
        votes: dict = {}
        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"]):
                if page:
                    nodes = parse(page)
                    weigh(nodes)
                    best = best_container(nodes)
                    if best.text and best.tag:
                        key = (host, best.path)
                        votes[key] = votes.get(key, 0.0) + round(best.text / max(nodes[0].text, 1), 3)
            if len(votes) > 50_000:
                yield pd.DataFrame([(*k, v) for k, v in votes.items()], columns=["host", "path", "votes"])
                votes = {}
        if votes:
            yield pd.DataFrame([(*k, v) for k, v in votes.items()], columns=["host", "path", "votes"])

    summed = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(run, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    rank = F.row_number().over(W.partitionBy("host").orderBy(F.desc(F.round("votes", 2)), F.desc(F.length("path")), "path"))
    return summed.withColumn("rank", rank).where("rank = 1").select("host", "path")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    paths = durable(winning_paths(pages), "paths")
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if paths.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def work(pages, paths):
        text = [_cut(page, path) for page, path in zip(pages, paths)]
        return text, [len(t) for t in text]

    made = with_columns(joined.withColumn("page_id", F.col("page_id").cast("long")), [F.col("html"), F.col("path")], "text string, n_chars long", work, keep=["page_id", "url", "path"])
    return made.select("page_id", "url", "text", "n_chars", "path")


def op2_consensus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
