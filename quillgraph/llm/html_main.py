"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is cut into its leaf blocks: runs of text between block-level tags. A
block's features are the tags and the class, id and role words of its ancestors,
and its text's length, links and ending. The CRF is trained on labelled pages,
which are made from the templates below, and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.common import columns_of, ship
from quillgraph.llm.crf import Crf
from quillgraph.llm.words import chunks

# quotes hold a value only right behind an equals sign; an open quote ends with its tag
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
# Elements by what they do to text.
# their content is no markup and no text, up to their end tag
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
# what is inside is not shown as text
UNSEEN = frozenset("noscript template canvas object audio video svg select".split())
# of these, the ones that a block element ends
PHRASING = frozenset("svg select".split())
BLOCK = frozenset(
    "html head body title article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend blockquote pre figure figcaption hr address details summary dialog menu center hgroup search option optgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"html", "head", "body", "title", "option", "optgroup"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TAGS = "nav header footer aside form article main head title section ul ol table figure figcaption blockquote pre h1 h2 h3 h4 p li td dl button label details dialog menu address fieldset a".split()
# Parts of class, id and role words, by what they say of a block.
CUES = {
    "nav": "nav menu breadcrumb crumb pagination pager tabs toc",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer copyright legal colophon contentinfo imprint",
    "side": "sidebar aside widget related recommend trending popular complementary rail",
    "ad": "advert ads sponsor promo adslot adbox banner-ad dfp outbrain taboola",
    "notice": "cookie consent gdpr notice alert popup modal overlay dialog announcement warning",
    "comment": "comment respond reply disqus discussion feedback",
    "share": "share social follow tweet facebook",
    "sign": "newsletter subscribe signup login register search form",
    "main": "content article post entry story main text body",
}
_AD_WORDS = frozenset("ad ads adv adverts".split())
# Words of notices, adverts and forms.
_ASIDE = ("cookie", "subscribe", "advertis", "newsletter", "sign in", "log in", "sponsored")
_NAMES = [*TAGS, *CUES, "hidden"]
_LENGTHS, _LINKS = (1, 15, 40, 80, 160, 320, 640), (0.001, 0.3, 0.7)
_N_TEXT = 6
N_FEATURES = 2 * len(_NAMES) + (len(_LENGTHS) + 1) + (len(_LINKS) + 1) + 2 + 2 + 2 + 4


def _mask(tag: str, attributes: str) -> int:
    bits = 1 << _NAMES.index(tag) if tag in TAGS else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return bits
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            words = re.split(r"[^a-z]+", value)
            for cue, parts in CUES.items():
                if any(p in value for p in parts.split()) or (cue == "ad" and _AD_WORDS.intersection(words)):
                    bits |= 1 << _NAMES.index(cue)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            bits |= 1 << _NAMES.index("hidden")
    return bits


class _Open:
    """The open elements of a page: innermost last, with the places of each tag and of the blocks."""

    def __init__(self) -> None:
        # (tag, bits of its ancestors and itself)
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = self.unseen = 0

    def mask(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def push(self, tag: str, bits: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN
        self.stack.append((tag, self.mask() | bits))

    def cut(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN

    def innermost(self, tag: str) -> int:
        """The place of the innermost open `tag`, -1 without one."""
        there = self.places.get(tag)
        return there[-1] if there else -1

    def block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def close(self, tag: str) -> None:
        place = self.innermost(tag)
        # the end of an element in a block never closes the block
        if place >= 0 and (tag in BLOCK or tag in UNSEEN or place > self.block()):
            self.cut(place)

    def begin_block(self, tag: str) -> None:
        """What a block's start closes: unseen phrasing, an open paragraph, and siblings like the item before."""
        for inner in PHRASING if tag not in ("option", "optgroup") else ():
            if (place := self.innermost(inner)) > self.block():
                self.cut(place)
        if tag in CLOSES_P and self.blocks and self.stack[self.block()][0] == "p":
            self.cut(self.block())
        if tag in SIBLINGS and self.blocks and self.stack[self.block()][0] in SIBLINGS[tag]:
            self.cut(self.block())


def leaf_blocks(page: str) -> list[tuple[str, int, float]]:
    """(text, ancestors, share of characters in links) of each leaf block with text, in page order.

    References are decoded in each run of text between tags, white space is one
    blank. The contents of scripts, styles, comments and unseen elements are no
    text. A self-closed element other than a block is empty; an unseen element
    without an end tag further on counts as empty, and one inside a block ends
    with it. Each tag costs a constant time, whatever is open.
    """
    out: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked = chars = 0
    open_now = _Open()
    masks: dict[tuple[str, str], int] = {}
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked, chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, open_now.mask() & ~for_link, linked / max(1, chars)))
            parts.clear()
            linked = chars = 0

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", page, re.I)), default=-1)
        return last_end[tag] >= at

    at, for_link = 0, 1 << _NAMES.index("a")
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        here = page[at : m.start() if m else n]
        if here and not open_now.unseen:
            parts.append(html.unescape(here))
            size = len(here.strip())
            chars += size
            linked += size if open_now.links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attributes = m[3]
        if m[1]:
            if tag in BLOCK:
                flush()
            open_now.close(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        empty = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not empty and (ends_later(tag) or tag in ("script", "style")):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in UNSEEN and (empty or not ends_later(tag)):
            continue
        if tag in BLOCK:
            flush()
            open_now.begin_block(tag)
        elif empty:
            continue
        if tag in VOID:
            continue
        key = (tag, attributes)
        if key not in masks:
            masks[key] = _mask(tag, attributes)
        open_now.push(tag, masks[key])
    flush()
    return out


def _features(blocks: list[tuple[str, int, float]]) -> np.ndarray:
    width = len(_NAMES)
    out = np.zeros((len(blocks), width + _N_TEXT), np.int64)
    if not blocks:
        return out
    names = np.arange(width)
    out[:, :width] = 2 * names + (np.array([b[1] for b in blocks], np.int64)[:, None] >> names & 1)
    at = 2 * width
    length = np.array([len(b[0]) for b in blocks])
    out[:, width] = at + np.searchsorted(_LENGTHS, length, "right")
    at += len(_LENGTHS) + 1
    out[:, width + 1] = at + np.searchsorted(_LINKS, [b[2] for b in blocks], "right")
    at += len(_LINKS) + 1
    out[:, width + 2] = at + np.array([b[0][-1] in ".!?\"'”»…:" for b in blocks])
    at += 2
    # in whole blocks, and only where such words are frequent
    out[:, width + 3] = at + np.array([80 * b[0].count("©") >= len(b[0]) for b in blocks])
    at += 2
    out[:, width + 4] = at + np.array([200 * sum(map(b[0].lower().count, _ASIDE)) >= len(b[0]) for b in blocks])
    at += 2
    out[:, width + 5] = at + np.minimum(3, np.array([b[0].count(" ") // 4 for b in blocks]))
    return out


def labelled_pages(pages: int = 260, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(html, main blocks): pages made from templates, with menus, headers, footers, sidebars, notices, adverts, forms and comments."""
    rng = np.random.default_rng(seed)
    some = lambda *x: x[rng.integers(len(x))]
    count = [0]

    def words(lo: int, hi: int) -> str:
        count[0] += 1
        return " ".join("".join(rng.choice(list("aeiourtnslmdhkgbp"), rng.integers(2, 8))) for _ in range(rng.integers(lo, hi))) + f" {count[0]}"

    def sentence(lo: int = 2, hi: int = 60) -> str:
        return words(lo, hi).capitalize() + some(".", ".", ".", "!", "?", "", "***", "!!")

    def attr(*names: str) -> str:
        x = some(*names)
        return some(f' class="{x}"', f' id="{x}"', f' class="{some("c1 ", "x-", "block ")}{x}"')

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(n))

    def chrome(where: str) -> str:
        text = lambda: sentence(2, 30)
        made = {
            "top": lambda: some(
                f"<nav><ul>{links(rng.integers(2, 9))}</ul></nav>", f"<header><div{attr('logo', 'masthead')}>{words(1, 5)}</div><nav>{links(3)}</nav></header>", f"<header><p>{text()}</p></header>",
                f"<div{attr('nav', 'main-menu', 'navbar', 'breadcrumbs')}><ul>{links(5)}</ul></div>", f"<div{attr('header', 'site-header', 'topbar')}><h2>{words(1, 6)}</h2><p>{text()}</p></div>", f"<ul{attr('menu', 'nav')}>{links(4)}</ul>",
            ),
            "ad": lambda: some(f"<div{attr('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'advertisement')}>{some('<p>', '')}{text()}</div>", f"<aside{attr('ad', 'promo')}><p>{text()}</p></aside>"),
            "notice": lambda: some(f"<div{attr('cookie-notice', 'cookie-banner', 'consent', 'notice', 'gdpr', 'popup', 'modal', 'alert')}><p>{text()}</p><button>{words(1, 3)}</button></div>", f'<div role="{some("alert", "dialog")}">{text()}</div>'),
            "side": lambda: some(f"<aside><h3>{words(1, 5)}</h3><p>{text()}</p><ul>{links(4)}</ul></aside>", f"<div{attr('sidebar', 'widget', 'related-posts', 'recommended', 'trending')}><h3>{words(1, 4)}</h3><p>{text()}</p><ul>{links(3)}</ul></div>"),
            "form": lambda: some(f"<form><label>{words(1, 4)}</label><input name=a><button>{words(1, 3)}</button></form>", f"<form{attr('search', 'newsletter', 'login')}><p>{text()}</p><select><option>{words(1, 2)}</option></select></form>", f"<div{attr('newsletter', 'subscribe', 'signup')}><p>{text()}</p></div>"),
            "comments": lambda: some(
                f"<section{attr('comments', 'comment-list', 'responses', 'discussion')}><h2>{words(1, 4)}</h2>" + "".join(f'<div class="comment"><p>{sentence(2, 50)}</p></div>' for _ in range(rng.integers(1, 5))) + "</section>",
                f"<div{attr('comments', 'comment-thread', 'disqus')}><ol>" + "".join(f"<li><p>{sentence(2, 50)}</p></li>" for _ in range(rng.integers(1, 4))) + "</ol></div>",
                f'<article class="comment"><p>{sentence(2, 50)}</p></article>',
            ),
            "share": lambda: f"<div{attr('share', 'social', 'share-buttons')}>{links(3)}</div>",
            "footer": lambda: some(f"<footer>&copy; {words(1, 4)} &middot; {text()}</footer>", f"<footer><p>{text()}</p><ul>{links(4)}</ul></footer>", f"<footer>&copy; site.example.org &middot; {text()}<br>{text()}</footer>", f"<div{attr('footer', 'site-footer', 'copyright')}><p>&copy; {text()}</p></div>"),
        }
        return made[where]()

    out = []
    for _ in range(pages):
        main: list[str] = []

        def block(text: str, main: list[str] = main) -> str:
            main.append(text)
            return text

        body = []
        if rng.random() < 0.85:
            body.append(f"<{(h := some('h1', 'h1', 'h2'))}>{block(words(2, 14))}</{h}>")
            if rng.random() < 0.3:
                body[-1] = f"<header>{body[-1]}</header>" if rng.random() < 0.5 else f"<div{attr('entry-header', 'article-header')}>{body[-1]}</div>"
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.7:
                body.append(some(f"<p>{block(sentence())}</p>", f"<p>{block(sentence())}", f"<p><b>{block(sentence())}<br>", f"<div>{block(sentence(8, 70))}</div>", f"<p>{block(sentence(1, 5))}</p>"))
            elif kind < 0.78:
                body.append(f"<{(h := some('h2', 'h3', 'h4'))}>{block(words(1, 8))}</{h}>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{block(sentence(1, 15))}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote><p>{block(sentence())}</p></blockquote>")
            elif kind < 0.94:
                body.append("<table><tr>" + "".join(f"<td>{block(words(1, 6))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                body.append(f"<pre>{block(words(2, 20))}</pre>")
            else:
                body.append(f"<figure><img src=x><figcaption>{block(sentence(2, 15))}</figcaption></figure>")
            if rng.random() < 0.08:
                body.append(chrome(some("ad", "share", "side", "form", "notice")))
        inner = "".join(body)
        if rng.random() < 0.12:
            inner += chrome("comments")
        wrap = some(
            lambda x: f"<article>{x}</article>", lambda x: f"<article>{x}</article>", lambda x: f"<main><article>{x}</article></main>", lambda x: f"<main>{x}</main>", lambda x: f"<div{attr('content', 'post', 'article-body', 'entry-content', 'story', 'main-content')}>{x}</div>",
            lambda x: f"<article{attr('post', 'article', 'story')}><div>{x}</div></article>", lambda x: f'<div role="main">{x}</div>', lambda x: f"<section{attr('content', 'article')}>{x}</section>",
        )
        parts = [chrome("top") for _ in range(rng.integers(0, 3))] + [chrome(some("ad", "notice", "form", "side")) for _ in range(rng.integers(0, 3))]
        tail = [chrome(some("comments", "side", "ad", "form", "share", "notice")) for _ in range(rng.integers(0, 4))] + ([chrome("footer")] if rng.random() < 0.85 else [])
        page = f"<!DOCTYPE html><html><head><title>{words(2, 10)}</title><script>var t=1;</script></head><body>{''.join(parts)}<!-- x -->{wrap(inner)}{''.join(tail)}" + some("</body></html>", "")
        out.append((page, {" ".join(x.split()) for x in main}))
    return out


@functools.cache
def trained_crf() -> Crf:
    table = [(leaf_blocks(p), main) for p, main in labelled_pages()]
    table = [(b, m) for b, m in table if b]
    labels = [np.array([int(any(t == x or t.rstrip(".") == x for x in m) if t not in m else 1) for t, _, _ in b]) for b, m in table]
    return Crf.trained([_features(b) for b, _ in table], labels, N_FEATURES, 2, steps=120, rate=0.1)


def main_texts(pages: list[str | None], crf: Crf) -> list[str]:
    """The main text of each page (null: none), its main blocks joined by line feeds."""
    blocks = [leaf_blocks(x or "") for x in pages]
    flat = [x for page in blocks for x in page]
    if not flat:
        return [""] * len(pages)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype(np.int64)
    keep = crf.decoded(crf.emit[_features(flat)].sum(1), starts)
    return ["\n".join(flat[j][0] for j in range(starts[i], starts[i + 1]) if keep[j]) for i in range(len(blocks))]


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page's whole html.

    pages: page_id, url, html. Null and empty html, and pages without main text,
    give empty text. Repeated rows give repeated rows, an empty table none;
    further columns, whatever their names, are left out.
    """
    ship(pages.sparkSession)
    crf = trained_crf()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunks(batches, "html"):
            texts = main_texts(some.column("html").to_pylist(), crf)
            yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return columns_of(pages, page_id="bigint", url="string", html="string").mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
