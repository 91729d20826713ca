"""Main text of web pages by tree scoring.

A page is parsed into a tree with the usual repairs (implied ends, void elements, raw text, unfinished ends).
Parts that are never article text are cut off by element, role, a style that hides them, or by a word of their class or id, unless they
wrap the largest ``article`` or ``main`` or most of the page's text; ids of headings, and of sections inside an
article, are slugs and cut nothing. A word that only may speak against a part (``form``, ``share``, ``search``) does not decide
where other words stand beside it (``market-share``) or inside an article: there the part goes if it is made of links, form controls
or no text at all. A page that comes out empty is read again without the rules on names. Every
paragraph-like block then scores ``1 + commas + min(length / 100, 3)``; the score passes to its parent in full,
to the grandparent by half, and to further ancestors by ever smaller shares. A container's score is discounted
by its link density and weighed by what its element and names promise. The best container is kept, widened to the
``article`` or ``main`` around it if there is one, and to articles beside it that are worth a fifth of it, else with the siblings that look like text.

Text is returned as blocks in page order, joined by an empty line. Character references are decoded, white
space within a block becomes one space; nothing else is dropped or cut.

One page at a time is parsed inside a task; a page's cost follows its length, and no stage shuffles.

Rows: null or empty html, and pages without text, give an empty string. Repeated pages give equal rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element groups of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html option td th tr tbody thead tfoot caption".split())
DROPPED = frozenset(
    "head script style title noscript template nav footer aside form button select option textarea input iframe object embed "
    "svg math canvas audio video dialog menu noembed noframes xmp map".split()
)
ALWAYS = DROPPED - frozenset("nav footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template head html".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINER = frozenset("article main".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
#: Words in class, id or role that mark parts outside the article, and those that mark it.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments discussion disqus respond "
    "replies reply cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget pager pagination skip search form "
    "complementary contentinfo hidden "
    "werbung anzeige anzeigen kommentar kommentare seitenleiste fusszeile fußzeile hinweis suche teilen menü "
    "publicité publicite commentaire commentaires recherche partager barre "
    "publicidad anuncio anuncios comentario comentarios cabecera buscar compartir aviso menú".split()
)
#: Of these, the words of parts that may hold more text than the article and never wrap it.
LONE_WORDS = frozenset(
    "comment comments discussion disqus respond replies reply cookie cookies consent gdpr kommentar kommentare commentaire commentaires "
    "comentario comentarios".split()
)
THREAD_WORDS = frozenset("comment comments disqus respond kommentar kommentare commentaire commentaires comentario comentarios".split())
#: Of these, the words that name other things as well.
LOOSE_WORDS = frozenset(
    "promo promotion banner menu notice notices alert overlay subscription signup login share sharing related recommended widget skip "
    "search form hidden anzeige anzeigen hinweis suche teilen menü recherche partager barre buscar compartir aviso menú cabecera".split()
)
#: Of these, the words that alone do not tell a part of an article.
SOFT_WORDS = frozenset("form menu search share sharing suche teilen menü recherche partager buscar compartir menú".split())
#: Words that only say what a part is made of or where it stands.
FRAME_WORDS = frozenset(
    "site page post global top bottom left right main primary secondary inner outer wrapper wrap container box block section area region "
    "bar list widget unit slot module panel row col button buttons link links icon icons".split()
)
ABOUT_WORDS = frozenset("has with without no is js".split())
GOOD_WORDS = frozenset("article content main post entry story body text page".split())
CONTROLS = frozenset("input button select textarea".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMING = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^\W\d_A-ZÀ-Þ]+|[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ]*")
_SPACE = re.compile(r"\s+")


class Names(NamedTuple):
    """What the names of an element say of it: ``bad`` against article text, ``loose`` only perhaps, ``soft`` not inside an article,
    ``good`` for it, ``slug`` against it by the id of a section alone, ``lone`` against it as a part that never wraps the article."""

    bad: bool = False
    loose: bool = False
    soft: bool = False
    good: bool = False
    slug: bool = False
    lone: bool = False


class Node:
    __slots__ = ("tag", "parent", "items", "bad", "loose", "soft", "good", "slug", "lone", "wraps", "plain", "whole", "controls", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, names: Names = Names()):
        self.tag, self.parent = tag, parent
        self.bad, self.loose, self.soft, self.good, self.slug, self.lone = names
        self.items: list = []
        self.wraps, self.plain, self.whole, self.controls = False, 0, 0, 0
        self.score, self.chars, self.linked = 0.0, 0, 0


def _named(tag: str, attributes: str) -> Names:
    """What the attributes say.

    A name with a bad word speaks against, unless it only says what the element has or lacks, or another
    name of the same attribute has good words alone: ``page-footer`` goes, ``content with-sidebar`` stays. It speaks loosely if its
    bad words have other meanings and a word beside them is no mere frame: ``market-share``.
    The id of a heading says nothing; that of a section is a slug unless it names a thread of comments.
    """
    if not _NAMING.search(attributes):
        return Names()
    bad = loose = good = slug = lone = False
    soft = True
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("hidden", "aria-hidden", "style"):
            if _UNSEEN.search(value) if name == "style" else name == "hidden" or value.lower() == "true":
                bad, soft = True, False
            continue
        if name not in ("class", "id", "role") or name == "id" and tag in HEADINGS:
            continue
        against = perhaps = by_itself = thread = False
        for token in value.split():
            words = {w.lower() for w in _WORDS.findall(token)}
            first = _WORDS.search(token)
            if first is None or first.group().lower() in ABOUT_WORDS:
                continue
            wrong = words & BAD_WORDS
            if wrong and wrong <= LOOSE_WORDS and not words <= BAD_WORDS | FRAME_WORDS:
                perhaps = True
            elif wrong:
                against = True
                soft &= wrong <= SOFT_WORDS
            lone |= bool(words & LONE_WORDS)
            thread |= bool(words & THREAD_WORDS)
            by_itself |= not wrong and bool(words & GOOD_WORDS)
        if against and not by_itself:
            if name == "id" and tag == "section" and not thread:
                slug = True
            else:
                bad = True
        loose |= perhaps and not by_itself
        good |= by_itself
    return Names(bad or slug, loose, bad and soft, good, slug and not bad, lone and (bad or slug))


def parse(page: str) -> Node:
    """The page as a tree of nodes and texts. Unfinished markup at the end is left out."""
    root = Node("#root", None)
    stack = [root]
    open_at: dict[str, list[int]] = {}

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_at[stack.pop().tag].pop()

    def last_open(tag: str) -> int:
        return open_at[tag][-1] if open_at.get(tag) else 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if stack[-1].tag == "head" and not page[at:lt].isspace():
                close_to(last_open("head"))
            stack[-1].items.append(page[at:lt])
        if lt >= n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _PLAIN_TAG.match(page, lt)
        if not m:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/") and page.find(">", lt) < 0:
                break
            stack[-1].items.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            depth = last_open(tag)
            if depth:
                close_to(depth)
            elif tag == "p":
                stack[-1].items.append(Node("p", stack[-1]))
            continue
        # the end of head may be left out: body and the first element of the flow imply it
        if last_open("head") and (tag == "body" or stack[-1].tag == "head" and tag not in IN_HEAD):
            close_to(last_open("head"))
        if tag in CLOSES_P and last_open("p"):
            close_to(last_open("p"))
        for other in IMPLIED.get(tag, ()):
            depth = last_open(other)
            if depth and depth > max((last_open(t) for t in ("ul", "ol", "table", "dl", "select")), default=0):
                close_to(depth)
        node = Node(tag, stack[-1], _named(tag, m.group(3)) if m.group(3) else Names())
        stack[-1].items.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def _mark(root: Node, names: bool) -> int:
    """Mark what wraps the largest article or main, or over half of the page's text. Returns the text's length.

    Text in links, in parts never shown, and in comments and consent notices does not count. Without ``names``
    no name speaks against a part any more.
    """
    chief: Node | None = None
    work: list = [(root, iter(root.items), False, False)]
    order: list[Node] = []
    while work:
        node, items, linked, held = work[-1]
        for item in items:
            if isinstance(item, str):
                size = len(item.strip())
                node.whole += size
                node.plain += 0 if linked else size
                continue
            if not names:
                item.bad = item.loose = item.slug = item.lone = False
            node.controls += item.tag in CONTROLS
            if item.tag in ALWAYS or item.lone and not (held and item.slug):
                continue
            work.append((item, iter(item.items), linked or item.tag == "a", held or item.tag in CONTAINER))
            break
        else:
            work.pop()
            order.append(node)
            if node.parent is not None:
                node.parent.plain += node.plain
                node.parent.whole += node.whole
                node.parent.controls += node.controls
            # the outermost ones only
            if node.tag in CONTAINER and not (work and work[-1][3]) and (chief is None or node.plain > chief.plain):
                chief = node
    for node in order:
        node.wraps = 2 * node.plain > root.plain
    while chief is not None:
        chief.wraps, chief = True, chief.parent
    return root.plain


def _outside(node: Node, within: bool, strict: bool = False) -> bool:
    """True for a part that is cut off. ``within``: inside an article or main element. ``strict``: wrapper or not."""
    if node.tag in CONTAINER or node.tag in ("body", "html"):
        return False
    if node.tag in ALWAYS:
        return True
    if node.wraps and not strict:
        return False
    bad = node.bad and not (within and node.slug)
    if bad and node.soft and within or not bad and node.loose:
        # the name alone does not tell: judge what is there
        bad = 2 * node.plain <= node.whole or node.controls > 0
    return node.tag in DROPPED or bad or node.tag == "header" and not within


def _walk(root: Node):
    """(node, item, kind) in page order; kind is enter, leave or text. Parts outside are skipped."""
    work: list = [(root, iter(root.items), root.tag in CONTAINER)]
    yield root, None, "enter"
    while work:
        node, items, within = work[-1]
        for item in items:
            if isinstance(item, str):
                yield node, item, "text"
            elif not _outside(item, within):
                yield item, None, "enter"
                work.append((item, iter(item.items), within or item.tag in CONTAINER))
                break
        else:
            work.pop()
            yield node, None, "leave"


def _blocks(root: Node) -> list[str]:
    """Texts between block borders, decoded and with single spaces."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append(text)
            held.clear()

    for node, text, kind in _walk(root):
        if kind == "text":
            held.append(text)
        elif node.tag in BLOCK:
            flush()
        elif node.tag == "br" and kind == "enter":
            held.append(" ")
    flush()
    return out


def _score(root: Node) -> list[Node]:
    """Containers with points. A block's own text counts once, at its nearest block element."""
    own: dict[int, list[str]] = {}
    order: list[Node] = []
    links = 0
    for node, text, kind in _walk(root):
        if kind == "enter":
            order.append(node)
            links += node.tag == "a"
        elif kind == "leave":
            links -= node.tag == "a"
            if node.parent is not None:
                node.parent.chars += node.chars
                node.parent.linked += node.linked
        else:
            size = len(text.strip())
            node.chars += size
            node.linked += size if links else 0
            at = node
            while at.tag not in BLOCK and at.parent is not None:
                at = at.parent
            own.setdefault(id(at), []).append(text)
    scored: dict[int, Node] = {}
    for node in order:
        text = _SPACE.sub(" ", "".join(own.get(id(node), ()))).strip()
        if not text:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        points *= 1 - node.linked / max(1, node.chars)
        # a paragraph passes its points on; text right inside a container counts for that container
        at, share = (node.parent, 0) if node.tag in PARAGRAPH and node.parent is not None else (node, 0)
        while at is not None and share < 8:
            at.score += points / (1 if share == 0 else 2 if share == 1 else share * 3)
            scored[id(at)] = at
            at, share = at.parent, share + 1
    return list(scored.values())


def _worth(node: Node) -> float:
    promise = 1.25 if node.tag in CONTAINER or node.good else 1.0
    return node.score * (1 - node.linked / max(1, node.chars)) * promise


def _beside(whole: Node, scored: list[Node]) -> list[Node]:
    """``whole`` and the articles next to it that are worth a fifth of it, in page order."""
    least = max(2.0, 0.2 * _worth(whole))
    known = {id(n) for n in scored}
    out = []
    for item in whole.parent.items if whole.parent is not None else [whole]:
        if item is whole:
            out.append(item)
        elif not isinstance(item, str) and item.tag == whole.tag == "article" and id(item) in known and not (item.bad or item.loose):
            if _worth(item) >= least and item.linked < 0.25 * max(1, item.chars):
                out.append(item)
    return out


def _around(best: Node) -> Node | None:
    """The outermost article or main element that holds the best container, or itself."""
    found, at = None, best
    while at is not None:
        if at.tag in CONTAINER:
            found = at
        at = at.parent
    return found


def main_text(page: str | None) -> str:
    """Blocks of the best container and its text-like siblings, joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    plain = _mark(root, True)
    text = _best_text(root)
    if text or not plain and not _NAMING.search(page):
        return text
    # all of it stood in parts whose names speak against it
    root = parse(page)
    return _best_text(root) if _mark(root, False) else ""


def _best_text(root: Node) -> str:
    scored = _score(root)
    if not scored:
        return ""
    best = max(scored, key=_worth)
    whole = _around(best)
    if whole is not None:
        return "\n\n".join(b for part in _beside(whole, scored) for b in _blocks(part))
    least = max(2.0, 0.2 * _worth(best))
    out: list[str] = []
    for item in best.parent.items if best.parent is not None else [best]:
        if isinstance(item, str) or item is not best and _outside(item, False, strict=True):
            continue
        dense = item.linked / max(1, item.chars) < 0.25
        paragraph = item.tag in PARAGRAPH and item.chars > 0 and dense
        if item is best or paragraph or dense and item.tag in BLOCK and _worth(item) >= least:
            out += _blocks(item)
    return "\n\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        arrays = [batch.column("key"), batch.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every page."""
    slim = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    out = slim.mapInArrow(_extract, "key long, url string, text string, n_chars long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
