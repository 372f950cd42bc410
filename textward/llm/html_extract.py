"""Main text of web pages by tag-path ratios.

A page becomes blocks of text in page order, each with its root-to-leaf path of tags; a step carries the element's classes, and
whether element, role or label name it as boilerplate (navigation, headers, footers, sidebars, notices, adverts, reader comments).
Text length and punctuation are aggregated by path, into characters and marks a block. Both ratios are smoothed along the
path: with the mean of those of the steps above it, each taken over all that stands below the step, so that a heading or a
list in a long text rises with it. Fused, the ratios are the path's score, zero for boilerplate. Paths without a score are
left out, and blocks on paths over a share of the scores' spread are the seeds of the content. The innermost container that
holds all seed text, or the article around it, gives the result: all its blocks on paths with a score, but lists of links.
Without such a container inside the body, all from the first seed to the last is taken, with the heading before it, the blocks
on the seeds' paths and those of the container that holds nearly all seed text.

Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line; nothing else is
dropped or cut. A null html is empty; a page without blocks gives an empty text. Parsing is linear in the page. Rows that
repeat are extracted each; an empty table gives no rows; columns other than page_id, url and html are unused.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no text of the page.
UNSEEN = frozenset("head script style title noscript template iframe object embed svg math canvas audio video select option button input textarea form noframes noembed xmp".split())
#: Elements that never hold main text.
DROPPED = UNSEEN | frozenset("nav footer aside menu dialog".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select".split())
CONTAINERS = frozenset("body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of the second opens.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: What an implied end must not reach beyond.
SCOPES = frozenset("table ul ol dl article section main body html td th div nav aside form footer header".split())
#: Words of class and id that name boilerplate.
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promos promotion banner menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget widgets footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular comment "
    "comments commentlist disqus reply replies respond responses discussion pager pagination copyright disclaimer skip search form paywall".split()
)
#: Those of LABELS that name nothing else; as an id, with no words besides LABELS and these.
CLEAR = frozenset(
    "ad ads adv advert adverts advertisement adbox adslot sponsor sponsored sponsors promo promos nav navbar breadcrumb breadcrumbs sidebar widget widgets footer masthead "
    "topbar toolbar gdpr notice notices popup modal overlay newsletter subscribe comment comments commentlist disqus pager pagination paywall".split()
)
PARTS = frozenset("area section list box container wrapper wrap block slot main page site".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>?", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
CLASS = re.compile(r"(?<![\w-])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: What a character within a link counts, share of the deviation over which a block is a seed, share of seed text in a container,
#: share of linked text from which a block is a link.
LINKED, SHARE, HELD, LINKS = 0.02, 0.8, 0.9, 0.6


class _Page:
    """Blocks and elements of one page. An element is its tag, parent, path and why it is dropped: 0 not, 1 by tag, 2 by label, 3 as
    a header, 4 by a label that may as well name a topic, 5 as a header by its id alone, 6 by a clear label in its id."""

    def __init__(self, source: str):
        self.tag, self.parent, self.why, self.path = [""], [-1], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.above, self.ends = [-1], [""]  # each path's parent and last tag
        self.block = [0]  # the nearest block-level element
        self.ids: dict[int, set[str]] = {}  # words of the ids that are labels, by element
        self.count: dict[str, int] = {}  # of open elements by tag
        self.stack = [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters within links
        self.parts: list[str] = []
        self.linked = self.in_link = 0
        self._parse(source)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.blocks.append((self.block[self.stack[-1]], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _pop_to(self, depth: int) -> None:
        for at in self.stack[depth:]:
            self.in_link -= self.tag[at] == "a"
            self.count[self.tag[at]] -= 1
        del self.stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
        depth = len(self.stack) - 1 if any(tag in ends and self.count.get(own, 0) for own, ends in CLOSES.items()) else 0
        while depth > 0:
            own = self.tag[self.stack[depth]]
            if own in CLOSES and tag in CLOSES[own]:
                self._pop_to(depth)
                break
            if own in SCOPES:
                break
            depth -= 1
        parent = self.stack[-1]
        why = 1 if tag in DROPPED else 0
        if not why and attributes:
            why = self._label(tag, attributes)
        if not why and tag == "header":
            why = 3  # headings of an article stay
        up = self.path[parent]
        self.path.append(self._path(up, tag, attributes) if tag in BLOCKS else up)
        self.block.append(len(self.tag) if tag in BLOCKS else self.block[parent])
        self.tag.append(tag)
        self.parent.append(parent)
        self.why.append(why)
        if tag not in VOID:
            self.stack.append(len(self.tag) - 1)
            self.count[tag] = self.count.get(tag, 0) + 1
            self.in_link += tag == "a"

    def _path(self, up: int, tag: str, attributes: str) -> int:
        names = CLASS.search(attributes) if attributes else None
        step = (up, f"{tag}.{names[1] or names[2] or names[3]}" if names else tag)
        if step not in self.paths:
            self.paths[step] = len(self.above)
            self.above.append(up)
            self.ends.append(tag)
        return self.paths[step]

    def _label(self, tag: str, attributes: str) -> int:
        found = 0
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return 1
            if name == "role" and value.lower() in ROLES:
                found = 2
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                words = {w.lower() for w in WORDS.findall(value)}
                labels = words & LABELS
                if name == "id" and (labels or "header" in words):
                    self.ids[len(self.tag)] = words
                if labels & CLEAR and words <= LABELS | PARTS if name == "id" else labels & CLEAR or len(labels) > 1:
                    # an id may be made of a title, which _dropped() sees
                    own = 2 if name == "class" else 6
                elif labels:
                    own = 4
                else:
                    own = (3 if name == "class" else 5) if "header" in words else 0
                # the surest one counts
                found = min(found or own, own or found, key=(2, 6, 3, 4, 5, 0).index)
        return found

    def _close(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[depth]]
            if own == tag:
                if tag in BLOCKS:
                    self._flush()
                self._pop_to(depth)
                return
            if tag not in BLOCKS and own in BLOCKS:
                return  # an inline end does not close a block

    def _text(self, text: str) -> None:
        if not text:
            return
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text)

    def _parse(self, source: str) -> None:
        at, lower = 0, None
        end_of_tags = max(source.rfind(">"), source.rfind("<!--"))
        while at <= end_of_tags and (m := MARKUP.search(source, at)):
            self._text(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = m[3] or m[6] or ""
            if tag == "br":
                self.parts.append(" ")
                continue
            self._open(tag, attributes)
            if tag in RAW:
                lower = lower or re.compile(r"</(script|style|textarea|title|xmp|iframe|noembed|noframes)[\s/>]", re.IGNORECASE)
                end = at
                while (e := lower.search(source, end)) and e[1].lower() != tag:
                    end = e.end()
                at = e.start() if e else len(source)
        rest = source[at:]
        self._text(rest)
        self._flush()

    def ancestors(self, at: int) -> Iterator[int]:
        while at >= 0:
            yield at
            at = self.parent[at]


def _dropped(page: _Page) -> np.ndarray:
    """Whether each block is in a boilerplate element. A labelled element that holds an article or main element, or, in a page
    without these, most of the plain text, is a wrapper: its label does not count. Within an article a label that may name a topic
    counts only where the text is mostly links; an id made of the element's own title, or a heading's, does not count there, nor,
    if it may name a topic and the text is not mostly links, in a page without article."""
    n = len(page.tag)
    size, full = np.zeros(n), np.zeros(n)
    title: list[str | None] = [None] * n  # the first heading in each element
    wraps = [t in ("article", "main") for t in page.tag]
    for at, text, linked in page.blocks:
        size[at] += len(text) - linked
        full[at] += len(text)
        if page.tag[at] in HEADINGS and title[at] is None:
            title[at] = text
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        size[up] += size[k]
        full[up] += full[k]
        wraps[up] |= wraps[k]
        if title[k] is not None and page.tag[up] not in HEADINGS:
            title[up] = title[k]
    hard, head, inside = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        up, why = page.parent[k], page.why[k]
        inside[k] = inside[up] or page.tag[k] in ("article", "main")
        if why >= 2 and why != 3 and (inside[k] or not wraps[0]):
            links = full[k] - size[k] >= LINKS * full[k]
            named = k in page.ids and (page.tag[k] in HEADINGS or page.ids[k] - PARTS <= {w.lower() for w in re.findall(r"[A-Za-z]+", title[k] or "")} - PARTS)
            if inside[k] and (why >= 4 and named or why == 4 and not links or why == 5) or not inside[k] and why in (4, 5) and named and not links:
                why = 0
        wrapper = (why >= 2 or page.tag[k] == "form") and (wraps[k] or not wraps[0] and size[k] > 0.6 * size[0])
        hard[k] = hard[up] or why in (1, 2, 4, 6) and not wrapper
        head[k] = head[up] or why in (3, 5) and not wrapper
        if head[k] and page.tag[k] in HEADINGS and inside[k]:
            head[k] = False
    return np.array([hard[at] or head[at] for at, _, _ in page.blocks], bool)


def _menus(page: _Page, blocks: list[tuple[int, str, int]], seeds: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Which blocks are of a list or container whose whole text is mostly links. None is within an article or main element, nor
    between seeds of the container that holds nearly all seed text."""
    n = len(page.tag)
    plain, linked = np.zeros(n), np.zeros(n)
    for at, text, own in blocks:
        plain[at] += len(text) - own
        linked[at] += own
    for k in range(n - 1, 0, -1):
        plain[page.parent[k]] += plain[k]
        linked[page.parent[k]] += linked[k]
    free = [t in ("article", "main") for t in page.tag]
    for k in range(1, n):
        free[k] |= free[page.parent[k]]
    first, last = np.flatnonzero(seeds)[[0, -1]]
    out = np.zeros(len(blocks), bool)
    for k, (at, text, own) in enumerate(blocks):
        if free[at] or inner[at] and first < k < last or own < LINKS * len(text) or page.tag[at] not in ("li", "ul", "ol", "div", "td", "span"):
            continue
        whole = page.parent[at] if page.tag[at] in ("li", "td") or plain[at] else at
        out[k] = linked[whole] >= LINKS * (plain[whole] + linked[whole])
    return out


def path_scores(page: _Page, blocks: list[tuple[int, str, int]], boilerplate: np.ndarray) -> np.ndarray:
    """Each block's path's score."""
    n = len(page.above)
    of = np.array([page.path[at] for at, _, _ in blocks])
    plain = ~boilerplate
    weights = np.array([len(t) - (1 - LINKED) * linked for _, t, linked in blocks])
    marks = np.array([len(PUNCTUATION.findall(t)) * (linked < LINKS * len(t)) for _, t, linked in blocks], float)
    own = np.stack([np.bincount(of[plain], weights=x[plain], minlength=n) for x in (np.ones(len(blocks)), weights, marks)])
    below = own.copy()
    for k in range(n - 1, 0, -1):  # a path follows its parent
        below[:, page.above[k]] += below[:, k]
    steps = below[1:] / np.maximum(below[0], 1)
    total, count = np.zeros((2, n)), np.zeros(n)
    for k in range(1, n):
        counts = page.ends[k] not in ("html", "body")
        total[:, k] = total[:, page.above[k]] + steps[:, k] * counts
        count[k] = count[page.above[k]] + counts
    ratios = own[1:] / np.maximum(own[0], 1)
    length, punctuation = np.where(count > 0, (ratios + total / np.maximum(count, 1)) / 2, ratios)
    return np.where(plain, (length * (1 + punctuation))[of], 0.0)


def extract(source: str | None) -> str:
    """Main text of one page."""
    page = _Page(source or "")
    markup = [t in UNSEEN for t in page.tag]
    for k in range(1, len(markup)):
        markup[k] |= markup[page.parent[k]]
    text = [k for k, (at, _, _) in enumerate(page.blocks) if not markup[at]]
    if not text:
        return ""
    scores = path_scores(page, [page.blocks[k] for k in text], _dropped(page)[text])
    blocks = [page.blocks[k] for k, s in zip(text, scores, strict=True) if s > 0]
    if not blocks:
        return ""
    scores = scores[scores > 0]
    lengths = np.array([len(t) - linked for _, t, linked in blocks], float)
    of = np.array([page.path[at] for at, _, _ in blocks])
    seeds = scores >= min(SHARE * scores.std(), scores.max()) if scores.std() > 0 else np.ones(len(scores), bool)
    weights = np.where(seeds, lengths, 0.0)
    held: dict[int, float] = {}
    for (at, _, _), w in zip(blocks, weights, strict=True):
        held[at] = held.get(at, 0.0) + w
    total = np.zeros(len(page.tag))
    for at, w in held.items():
        total[at] = w
    for k in range(len(page.tag) - 1, 0, -1):
        total[page.parent[k]] += total[k]
    box = core = 0
    for k in range(1, len(page.tag)):  # children follow their parents
        # two that hold nearly all are one within the other
        if page.tag[k] in CONTAINERS and total[k] >= HELD * total[0] and total[0] > 0:
            core = k
            if total[k] == total[0]:
                box = k
    around = [a for a in page.ancestors(box) if page.tag[a] in ("article", "main")]
    box = next((a for a in around if page.tag[a] == "article"), around[0] if around else box)
    within, inner = np.zeros(len(page.tag), bool), np.zeros(len(page.tag), bool)
    within[box] = True
    inner[core] = page.tag[core] not in ("", "html", "body")
    for k in range(box + 1, len(page.tag)):
        within[k] = within[page.parent[k]]
        inner[k] |= inner[page.parent[k]]
    take = np.array([within[at] for at, _, _ in blocks]) & ~_menus(page, blocks, seeds, inner)
    if page.tag[box] in ("", "html", "body"):
        own = np.isin(of, np.unique(of[seeds]))
        first, last = np.flatnonzero(seeds)[[0, -1]]
        headings = np.array([page.tag[at] in HEADINGS for at, _, _ in blocks])
        near = np.arange(len(blocks))
        take &= own | np.array([inner[at] for at, _, _ in blocks]) | (near >= first) & (near <= last) | headings & (near == first - 1)
    titles = [k for k, (at, _, _) in enumerate(blocks) if page.tag[at] == "h1"]
    if len(titles) == 1 and take.any() and titles[0] < np.flatnonzero(take)[0]:
        take[titles[0]] = True  # the only main heading stands before the container
    return "\n\n".join(t for (_, t, _), x in zip(blocks, take, strict=True) if x)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [extract(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select("page_id", "url", "html")
    return kept.mapInArrow(run, kept.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
