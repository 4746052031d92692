"""Main text of web pages by tree scoring.

A page becomes a tree. Subtrees that by element, role or name are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
go. Every paragraph then gets points for its length and its commas and passes
them to its ancestors, fewer the further up; each container's points are
discounted by the share of its text that lies in links. The best container, or
the lowest one around it that holds half of all points, is kept with those of its siblings, and of its ancestors' siblings, that score
well; inside them, lists and blocks that are mostly links are left out, but for
lists that a heading or a paragraph ending in a colon announces (references).

No walk recurses, so elements may be nested to any depth, and each is linear in
the page; points go up to ``REACH`` ancestors, by then a hundredth of them.

Defined cases: null or empty html gives an empty text; a page without any
paragraph of ``least_chars`` gives the text of its first ``article`` or ``main``,
else of its body; of containers with equal scores the one scored first is best; broken
markup is read as browsers do (unclosed elements end with their parent, a paragraph
with the next block); very long pages are read to their end. Repeated rows are treated
one by one, other columns of ``pages`` ignored, an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.session import table

from .common import map_batches

#: An attribute as browsers read it: a quote opens a value only after ``=``. No part gives anything back, so tags are read in one pass.
_ATTR = re.compile(r"""(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_ATTRS = r"""(?:[\s/]++|(?:=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
_TOKEN = re.compile(rf"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})(?:>|\Z)""", re.S)
_NAME_PART = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTIONING = frozenset("section div aside article".split())
#: A start tag of the key ends an open element of the value, up to a boundary.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_DROP = frozenset("head script style noscript template iframe object embed svg annotation annotation-xml canvas audio video nav footer aside form button select textarea input label option dialog menu map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note status".split())
_BAD = frozenset("ad ads adv advert adverts advertisement advertising adslot adbox adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager paging toolbar footer footnav masthead sidebar aside rail widget widgets related recommended recommendations recommend teaser teasers trending popular outbrain taboola comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register paywall share sharing social follow search skip skiplink legal copyright disclaimer toc tags".split())
#: Names that mark something unwanted only by themselves or with words of layout: an article may have a legal-analysis or related-work.
_UNSURE = frozenset("legal copyright notice notices related popular trending search share sharing social follow reply replies respond discussion response alert promotion menu subscription sponsor sponsored".split())
_LAYOUT = frozenset("left right top bottom inner outer wrap wrapper container box list item items block section area content panel unit col column row header heading title body link links button buttons icon icons text primary secondary global site page post posts article articles story stories news fixed sticky mobile desktop small large bar form group topics module feed card cards".split())
#: Names that speak of a subject, not of a part of the page.
_SUBJECT = re.compile(r"\b(?:ad hoc|(?:comments?|notices?|discussion|repl(?:y|ies)|responses?) (?:on|of|about|to) [a-z]+)")
REACH = 32
_WEAK = frozenset("header meta info tools extra".split())
_GOOD = frozenset("article main content post entry story text body page".split())
#: Names by which an element says that it holds the article.
_ARTICLE_BODY = re.compile(r"(?i)\b(?:article|post|entry|story)[-_]?(?:body|content|text)\b")
_NEVER = frozenset("html body main".split())
#: A start tag of a block looks for an open paragraph or heading up to the nearest of these.
_P_SCOPE = ("p", *sorted(_HEADING), "table", "td", "th", "li", "div", "button", "article", "section")


class Node:
    __slots__ = ("tag", "attrs", "up", "depth", "kids", "score", "points", "chars", "linked", "commas", "anchors", "within", "before", "holds", "mains", "lead")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.depth: int = up.depth + 1 if up else 0
        self.kids: list[Node | str] = []
        self.score = self.points = 0.0
        self.chars = self.linked = self.commas = self.anchors = self.within = 0  # within: links to places of the same page
        self.before: Node | str | None = None  # what stands before it in its parent
        self.holds = tag in ("article", "main")  # or has such an element inside
        self.mains = tag == "main"
        self.lead: Node | None = None  # the heading that a block begins with


def preorder(x: Node, into=lambda k: True) -> Iterator[Node]:
    """The node and those below it in page order; ``into`` tells whose kids are visited."""
    stack = [x]
    while stack:
        x = stack.pop()
        yield x
        if into(x):
            stack.extend(k for k in reversed(x.kids) if isinstance(k, Node))



def tree(page: str) -> Node:
    root = Node("html", "", None)
    top, at = root, 0
    open_: defaultdict[str, list[Node]] = defaultdict(list)  # open elements by tag, innermost last, so that no walk up is needed
    absent: set[str] = set()  # raw elements without an end tag in what is left

    def close(x: Node) -> Node:
        nonlocal top
        while top is not x:
            open_[top.tag].pop()
            top = top.up
        open_[x.tag].pop()
        return x.up

    def nearest(tags: Iterable[str]) -> Node | None:
        return max((open_[t][-1] for t in tags if open_[t]), key=lambda x: x.depth, default=None)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            top.kids.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            x = nearest((tag,))
            bound = None if tag in _BLOCK else nearest(("table", "article", "body"))
            if x is not None and (bound is None or bound.depth < x.depth):
                top = close(x)
            continue
        if tag == "html":
            continue
        if tag in _BLOCK and tag != "body":
            x = nearest(_P_SCOPE)
            if x is not None and (x.tag == "p" or x.tag in _HEADING and tag in _HEADING):
                top = close(x)
        if tag in _ENDS:
            ends, stop = _ENDS[tag]
            x = nearest(ends | stop)
            if x is not None and x.tag in ends:
                top = close(x)
        node = Node(tag, m[3], top)
        top.kids.append(node)
        if tag in _RAW:
            end = None if tag in absent else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end is None:
                absent.add(tag)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
        elif tag not in _VOID and not m[3].endswith("/"):
            top = node
            open_[tag].append(node)
    if at < len(page):
        top.kids.append(page[at:])
    for x in reversed(list(preorder(root))):
        x.holds = x.holds or any(k.holds for k in x.kids if isinstance(k, Node))
        x.mains = x.mains or any(k.mains for k in x.kids if isinstance(k, Node))
        if x.tag in _SECTIONING:
            first = next((k for k in x.kids if isinstance(k, Node) or k.strip()), None)
            if isinstance(first, Node):
                x.lead = first if first.tag in _HEADING else first.lead if first.tag == "div" and x.tag != "article" else None
    return root


def unwanted(x: Node, inside: bool) -> bool:
    """Whether the subtree is no part of an article. ``inside``: it lies in an article element."""
    if x.tag in _NEVER:
        return False
    if x.tag in _DROP:
        return True
    if x.tag == "header" and not inside:
        return True
    if not x.attrs or "=" not in x.attrs and "hidden" not in x.attrs:
        return False
    a: dict[str, str] = {}
    for m in _ATTR.finditer(x.attrs):
        a.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in _ROLES:
        return True
    parts = [p.lower() for p in _NAME_PART.findall(f"{a.get('class', '')} {a.get('id', '')}")]
    if not parts or x.tag in ("a", "span", "b", "i", "em", "strong") and not {"ad", "ads", "advert", "sponsored"} & set(parts):
        return False
    bad = [p for p in parts if p in _BAD]
    good = [p for p in parts if p in _GOOD]
    if not bad:
        return bool([p for p in parts if p in _WEAK]) and not good and not inside and not x.holds
    if not {"comment", "comments", "related", "recommended"} & set(bad) and x.holds:
        return False  # a frame round the article, named after what else it holds
    if inside and _UNSURE.issuperset(bad) and not (_BAD | _LAYOUT).issuperset(parts):
        return False
    if inside and _SUBJECT.search(" ".join(parts)):
        return False
    return {"with", "has", "no"}.isdisjoint(parts)


#: Headings of what follows an article.
_AFTER = re.compile(r"(?i)^\W*(?:\d+\W+)?(?:(?:reader |user )?comments?|leave a (?:reply|comment)|join the discussion|\d+ responses?|responses? \(\d+\)|related(?: (?:articles?|posts?|stories|news|links|reading|content|topics|pages|coverage|videos))?|read (?:more|next)|more (?:stories|from .*)|you may also like|share this|advertisement|newsletter|subscribe|kommentare|commentaires|comentarios)\W*(?:\(?\d+\)?)?\W*$")


#: A heading that a part of an article may have as well: what is below it decides.
_MAYBE_AFTER = re.compile(r"(?i)^\W*responses?\W*$")
_OF_READERS = frozenset("form textarea time article".split())


def headed_after(x: Node, known: dict[int, bool]) -> bool:
    """Whether a block begins with a heading that announces comments, other articles or the like."""
    if x.lead is None:
        return False
    if id(x.lead) not in known:
        head = " ".join("".join(texts(x.lead)).split())
        known[id(x.lead)] = bool(_AFTER.match(head)) or bool(_MAYBE_AFTER.match(head)) and any(k.tag in _OF_READERS for k in preorder(x))
    return known[id(x.lead)]


def texts(x: Node) -> Iterator[str]:
    stack = list(reversed(x.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            yield entities.unescape(k)
        else:
            stack.extend(reversed(k.kids))


def prune(root: Node) -> None:
    stack, known = [(root, False)], {}
    while stack:
        x, inside = stack.pop()
        inside = inside or x.tag == "article"
        kids = []
        for k in x.kids:
            if isinstance(k, Node):
                if unwanted(k, inside) or headed_after(k, known) and not k.mains:
                    continue
                if k.tag == "header":  # of an article: its headings and running text stay
                    keep_headings(k)
                stack.append((k, inside))
            kids.append(k)
        x.kids = kids


def keep_headings(x: Node, least_chars: int = 60) -> None:
    for x in preorder(x, lambda k: k.tag not in _HEADING and k.tag != "p"):
        if x.tag not in _HEADING and x.tag != "p":
            x.kids = [k for k in x.kids if isinstance(k, Node) and (k.tag in _HEADING or k.tag in ("div", "hgroup") or k.tag == "p" and sum(map(len, texts(k))) >= least_chars)]


_WITHIN = re.compile(r"""(?i)\bhref\s*+=\s*+["']?#""")


def count(root: Node) -> None:
    """Characters, those in links, commas and links of each subtree, and what stands before each element."""
    nodes, linked = list(preorder(root)), {id(root)} if root.tag == "a" else set()
    for x in nodes:
        if x.tag == "a" or x.up is not None and id(x.up) in linked:
            linked.add(id(x))
    for x in reversed(nodes):
        before = None
        for k in x.kids:
            if isinstance(k, Node):
                k.before = before
                before = k
                x.chars += k.chars
                x.linked += k.linked
                x.commas += k.commas
                x.anchors += 1 if k.tag == "a" else k.anchors
                x.within += bool(_WITHIN.search(k.attrs)) if k.tag == "a" else k.within
            elif t := k.strip():
                before = k
                x.chars += len(t)
                x.linked += len(t) * (id(x) in linked)
                x.commas += t.count(",") + t.count("、") + t.count("，")


def own_text(x: Node) -> bool:
    return any(isinstance(k, str) and k.strip() for k in x.kids)


def paragraphs(root: Node) -> list[Node]:
    """Elements that hold running text, not nested in each other, and blocks with text of their own beside such."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        inner = [k for k in x.kids if isinstance(k, Node)]
        if x.tag in ("p", "pre", "blockquote", "td", "li", "dd", "figcaption") and not any(k.tag in _BLOCK for k in inner):
            out.append(x)
            continue
        if x.tag in _BLOCK and x.tag not in _HEADING and own_text(x) and not any(k.tag == "p" for k in inner):
            out.append(x)
        stack.extend(k for k in reversed(inner) if k.tag not in _HEADING)
    return out


def density(x: Node) -> float:
    return x.linked / x.chars if x.chars else 0.0


def chosen(root: Node, least_chars: int, least_share: float) -> list[Node]:
    """The best container and what else is kept, in page order."""
    scored: dict[int, Node] = {}
    total = 0.0
    for p in paragraphs(root):
        if p.chars < least_chars:
            continue
        points = (1 + p.commas + min(p.chars / 100, 3)) * (1 - density(p))
        p.points += points
        total += points
        x, level = p.up if p.tag not in ("div", "section", "article", "main", "body") else p, 0
        while x is not None and level < REACH:
            x.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(x)] = x
            x, level = x.up, level + 1
    if not scored:
        return []
    final = {i: x.score * (1 - density(x)) for i, x in scored.items()}
    best = scored[max(final, key=final.get)]
    best = article_of(best) or holder(root, best, total)
    need = least_share * final.get(id(best), best.score)
    keep = {id(best)}
    x = best
    while x.up is not None and x.tag not in ("article", "main", "body"):
        for s in x.up.kids:
            if isinstance(s, Node) and s is not x:
                mine = final.get(id(s), 0.0)
                text = s.tag in ("p", "pre", "blockquote") and s.chars >= least_chars and density(s) < 0.25
                head = s.tag in ("h1", "h2") and density(s) < 0.5
                if mine >= need or text or head and x is best:
                    keep.add(id(s))
        x = x.up

    return [x for x in preorder(root, lambda x: id(x) not in keep) if id(x) in keep]


def holder(root: Node, best: Node, total: float) -> Node:
    """The lowest of ``best`` and its ancestors with half of all points or more inside: paragraphs may each stand in wrappers of their own."""
    for x in reversed(list(preorder(root))):
        x.points += sum(k.points for k in x.kids if isinstance(k, Node))
    while best.up is not None and 2 * best.points < total:
        best = best.up
    return best


def announced(x: Node) -> bool:
    """Whether a list of links belongs to the article: after a heading or a paragraph with a colon, and not of links within the page."""
    if x.tag not in ("ul", "ol", "dl"):
        return False
    before = x.before
    if not isinstance(before, Node) or not (before.tag in _HEADING or before.tag == "p" and "".join(texts(before)).rstrip().endswith(":")):
        return False
    return 2 * x.within < x.anchors


_LISTS = frozenset("ul ol dl div section".split())


def article_of(x: Node | None) -> Node | None:
    """The element that says that it holds the article, if ``x`` is one or lies inside."""
    while x is not None and x.tag not in ("article", "main") and not _ARTICLE_BODY.search(x.attrs):
        x = x.up
    return x


def blocks(root: Node, linked_share: float = 0.5) -> list[str]:
    """Texts of the blocks of a subtree in page order, without those that are mostly links; of an article only lists and containers of links go."""
    listed = _LISTS if article_of(root) else _LISTS | {"table", "p"}
    out: list[str] = []
    run: list[str] = []
    stack: list[Node | str | None] = [root]  # None: a block ends

    def close() -> None:
        if t := " ".join("".join(run).split()):
            out.append(t)
        run.clear()

    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(entities.unescape(x))
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in listed and x.linked and density(x) > linked_share and (x.tag != "p" or density(x) > 0.9) and x.anchors > (1 if x.tag != "p" else 2) and not announced(x) and not any(announced(k) for k in x.kids if isinstance(k, Node)):
            continue
        else:
            if x.tag in _BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(x.kids))
    close()
    return out


def find(x: Node, tags: tuple[str, ...]) -> Node | None:
    return next((k for k in preorder(x) if k.tag in tags), None)


def main_text(page: str | None, least_chars: int = 25, least_share: float = 0.2) -> str:
    if not page:
        return ""
    for strip in (prune, bare):
        root = tree(page)
        strip(root)
        count(root)
        kept = chosen(root, least_chars, least_share) or [find(root, ("article",)) or find(root, ("main",)) or find(root, ("body",)) or root]
        if got := [t for x in kept for t in blocks(x)]:
            return "\n\n".join(got)
    return ""


_NO_TEXT = frozenset("head script style noscript template iframe object embed svg annotation annotation-xml audio video select textarea button input".split())


def bare(root: Node) -> None:
    """For a page of which :func:`prune` leaves nothing, such as one inside a single form: without what is no text."""
    for x in preorder(root):
        x.kids = [k for k in x.kids if isinstance(k, str) or k.tag not in _NO_TEXT]


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, least_chars: int = 25, least_share: float = 0.2) -> DataFrame:
    """One row a page; no shuffle."""

    def factory():
        def f(b: pa.RecordBatch) -> dict:
            texts = [main_text(h, least_chars, least_share) for h in b.column(2).to_pylist()]
            return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    return map_batches(pages.select("page_id", "url", "html"), factory, EXTRACTED)


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
