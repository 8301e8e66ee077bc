"""Operator 4: main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside elements that are never part of an article
(navigation, page header and footer, scripts, hidden elements, comments, consent and the like, known by tag, role, class or
id) are out. Forms, and elements whose class or id names a sidebar, widget, notice, advert and so on, are out only
where the names tell the truth: such an element stays in if it holds more than half of the page's prose, more than twice what
stands in no such element, and all text of articles but for links: the name then tells how the page is laid out
(`layout-sidebar`, a page in one form).
The first pass judges all other blocks by length, link density and stop-word density: good, nearly good, short
or bad. In the second pass short and nearly good blocks inherit the label of the nearest decided neighbours.

Stop words of four languages are known. On a page without prose by these rules, whose long blocks have next to none of
them, length and links decide alone; on one of short blocks only, without links, all are kept if there is a heading and a block that ends as a sentence does.

Article and main elements are a prior, and only where they hold at least half of the good and nearly good text: running
text inside, which may have few stop words, is then nearly good at least, blocks inside inherit from blocks inside, and
blocks outside are kept where good text stands outside too, and inherit from one another. Elsewhere they decide nothing.

Character references are decoded, white space in a block becomes one space, blocks are joined by one newline. One
<br> is a space, two are the end of a block. Null and empty pages, and pages without a good block, give the
empty text. A page that ends in the middle of a tag or a script ends there. Rows are independent.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from folioseek.llm.common import arrow_schema, text_slices, with_columns

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

#: Elements by their part in a page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("head nav footer aside button select menu dialog noscript template svg math object audio video canvas map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
OUT_UNLESS_PROSE = frozenset("form fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id values, and roles, of what is no part of an article.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer foot masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay toast newsletter subscribe subscription signup login paywall "
    "comment comments disqus replies respond share sharing social follow related recommended recommendations trending widget widgets "
    "toolbar skip copyright legal disclaimer search searchbox form".split()
)
#: Those of them that are out however much text they hold.
ALWAYS_OUT = frozenset("comment comments disqus replies respond cookie cookies consent gdpr".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
IN_NAMES = frozenset("article main content post story entry body text".split())

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to a in is that it was for on are as with his they at be this from have or by one had not but what all were we when your can "
    "said there use an each which she do how their if will up other about out many then them these so some her would him into has "
    "der die das und in zu den ist nicht von mit sich des auf für im dem ein eine als auch es an werden aus er hat dass sie nach bei um noch wie "
    "einer über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn "
    "le la les de des du et en un une est que qui dans pour pas sur au par plus avec ce se ne il elle sont son sa ou mais nous vous été comme "
    "el los las del y que en un una es se no por con para su al lo como más pero sus este ha me si sobre este entre cuando".split()
)

SHORT = 70  # characters of a short block
LONG = 200
LINKS = 0.2  # share of characters in links of a bad block
ARTICLE_LINKS = 0.5  # the same inside an article
STOP_LOW, STOP_HIGH = 0.15, 0.3
STOP_NONE = 0.05  # less than this: text of a language without known stop words
SENTENCE_END = tuple(".!?\u2026\u3002\uff01\uff1f")
IN, UNLESS_PROSE, SHUT = 0, 1, 2
GOOD, NEAR, BRIEF, BAD = "good", "nearly good", "short", "bad"


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    heading: bool
    inside: bool  # in an article or main element
    around: int = -1  # the innermost open element that is out unless it holds the prose
    label: str = ""


def named_out(value: str) -> int:
    """What a class or id value says: `post-comments`, `adBanner` are no part of an article; `page-with-sidebar` may be."""
    said = IN
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        layout = next((i for i, w in enumerate(words) if w in ("has", "with", "no", "without")), len(words))
        words = words[:layout]
        if not words:
            continue
        for names, level in ((ALWAYS_OUT, SHUT), (OUT_NAMES, UNLESS_PROSE)):
            if words[-1] in names or not IN_NAMES.intersection(words) and names.intersection(words):
                said = max(said, level)
    return said


def shut_out(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """Whether an element holds nothing of an article: IN, UNLESS_PROSE or SHUT."""
    if tag in OUT or (tag == "header" and not inside):
        return SHUT
    said = UNLESS_PROSE if tag in OUT_UNLESS_PROSE else IN
    if not attributes or tag in ("html", "body"):
        return said
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return SHUT
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "").lower()):
        return SHUT
    if attributes.get("role", "").lower() in OUT_ROLES:
        return SHUT
    if tag == "main":  # a page has one, and its class says how it is laid out
        return said
    return max(said, named_out(attributes.get("class", "")), named_out(attributes.get("id", "")))


def attributes_of(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


class Reader:
    """Cuts one page into the blocks that are not shut out, each with the doubtful element around it."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, shuts out, is an article
        self.doubtful: list[int] = []  # by element that is out unless it holds the prose: the one around it, or -1
        self.around = -1
        self.out = self.articles = self.links = 0
        self.text: list[str] = []
        self.linked, self.heading, self.breaks = 0, False, 0

    def end_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append(Block(text, self.linked, self.heading, self.articles > 0, self.around))
        self.text, self.linked, self.heading, self.breaks = [], 0, False, 0

    def words(self, raw: str) -> None:
        if self.out or not raw:
            return
        text = html.unescape(raw)
        if not text.isspace():
            self.breaks = 0
            if self.links:
                self.linked += len(SPACE.sub(" ", text).strip())
        self.text.append(text)

    def start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.text.append(" ")
            if self.breaks == 2:
                self.end_block()
            return
        if tag in BLOCK:
            self.end_block()
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or tag in HEADING:
                self.close_open(tag)
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            return
        attributes = attributes_of(raw)
        out = shut_out(tag, attributes, self.articles > 0)
        article = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        self.stack.append((tag, out, article))
        self.out += out == SHUT
        if out == UNLESS_PROSE:
            self.doubtful.append(self.around)
            self.around = len(self.doubtful) - 1
        self.articles += article
        self.links += tag == "a"
        self.heading = self.heading or tag in HEADING

    def close_open(self, tag: str) -> None:
        """A new paragraph or item ends the open one of its kind."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag or tag == "p" and name in HEADING:
                self.pop_to(i)
                return
            if name in BLOCK:
                return

    def pop_to(self, at: int) -> None:
        for tag, out, article in self.stack[at:]:
            self.out -= out == SHUT
            if out == UNLESS_PROSE:
                self.around = self.doubtful[self.around]
            self.articles -= article
            self.links -= tag == "a"
        del self.stack[at:]

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self.pop_to(i)
                return
            if tag not in BLOCK and name in BLOCK:
                return  # an inline end without its start

    def read(self, page: str) -> list[Block]:
        at, end = 0, len(page)
        while at < end:
            m = TAG.search(page, at)
            if not m:
                self.words(page[at:])
                break
            self.words(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.end(tag)
            elif tag in RAW:
                closing = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = closing.end() if closing else end
            else:
                self.start(tag, m[3] or m[6] or "")
        self.end_block()
        return self.blocks


def first_pass(block: Block) -> str:
    size = len(block.text)
    links = block.linked / size
    if links > LINKS:
        return BAD
    if size < SHORT:
        return BAD if links else BRIEF
    words = [w.lower() for w in WORD.findall(block.text)]
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= STOP_HIGH:
        return GOOD if size > LONG else NEAR
    return NEAR if stops >= STOP_LOW else BAD


def within_article(block: Block) -> str:
    """The label of the first pass, raised by the prior of the article."""
    if block.linked / len(block.text) > ARTICLE_LINKS:
        return BAD
    if len(block.text) < SHORT:
        return BRIEF
    return GOOD if block.label == GOOD else NEAR


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks inherit from the nearest decided ones; between a good and a bad one, only nearly good ones are good."""
    if not any(b.label in (GOOD, BAD) for b in blocks):
        sentences = all(b.label == BRIEF for b in blocks) and any(b.text.endswith(SENTENCE_END) and not b.heading for b in blocks)
        sentences = sentences and any(b.heading for b in blocks)
        for b in blocks:
            b.label = GOOD if b.label == NEAR or b.inside or sentences else BAD
        return
    decided = [b.label if b.label in (GOOD, BAD) else None for b in blocks]
    before, last = [], None
    for d in decided:
        last = d or last
        before.append(last)
    after, last = [None] * len(blocks), None
    for i in range(len(blocks) - 1, -1, -1):
        last = decided[i] or last
        after[i] = last
    for i, b in enumerate(blocks):
        if b.label in (GOOD, BAD):
            continue
        near = {before[i] or after[i], after[i] or before[i]}
        if near == {GOOD}:
            b.label = GOOD
        elif near == {BAD}:
            b.label = BAD
        else:  # a heading belongs to what follows
            b.label = after[i] if b.heading else GOOD if b.label == NEAR else BAD


def prose_size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks if b.label in (GOOD, NEAR))


def known_language(blocks: list[Block]) -> bool:
    """Whether long blocks have some of the known stop words."""
    words = [w.lower() for b in blocks if len(b.text) >= SHORT for w in WORD.findall(b.text)]
    return sum(w in STOP_WORDS for w in words) >= len(words) * STOP_NONE


def by_length(block: Block) -> str:
    """The first pass without stop words."""
    if block.linked > len(block.text) * LINKS or len(block.text) < SHORT:
        return block.label
    return GOOD if len(block.text) > LONG else NEAR


def not_shut(blocks: list[Block], doubtful: list[int]) -> list[Block]:
    """The blocks but for those in doubtful elements that do not hold the page's prose."""
    if not doubtful:
        return blocks
    held = [[0, 0] for _ in doubtful]  # prose, and text of articles that is not links
    whole, free = [0, 0], 0
    for b in blocks:
        prose = prose_size([b])
        running = len(b.text) if b.inside and b.linked <= len(b.text) * ARTICLE_LINKS else 0
        free += (prose or running) * (b.around < 0)
        for n in (whole, held[b.around]) if b.around >= 0 else (whole,):
            n[0] += prose or running
            n[1] += running
    for i in range(len(doubtful) - 1, -1, -1):
        if doubtful[i] >= 0:
            held[doubtful[i]][0] += held[i][0]
            held[doubtful[i]][1] += held[i][1]
    out: list[bool] = []
    for parent, (prose, running) in zip(doubtful, held):
        most = 2 * prose > whole[0] and prose > 2 * free and running == whole[1]
        out.append(parent >= 0 and out[parent] or not most)
    return [b for b in blocks if b.around < 0 or not out[b.around]]


def main_text(page: str | None) -> str:
    reader = Reader()
    blocks = reader.read(page or "")
    for b in blocks:
        b.label = first_pass(b)
    if not prose_size(blocks) and not known_language(blocks):
        for b in blocks:
            b.label = by_length(b)
    blocks = not_shut(blocks, reader.doubtful)
    inner, outer = [b for b in blocks if b.inside], [b for b in blocks if not b.inside]
    if inner and prose_size(inner) >= prose_size(outer):
        for b in inner:
            b.label = within_article(b)
        second_pass(inner)
        if any(b.label == GOOD for b in outer):
            second_pass(outer)
        else:
            for b in outer:
                b.label = BAD
    else:
        second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract_main_text(pages: DataFrame, source: str = "html", to: str = "text") -> DataFrame:
    """`pages` without the column `source`, with its main text as column `to` and n_chars (code points)."""
    new = {to: "string", "n_chars": "long"}
    kept = [f for f in pages.schema if f.name not in new and f.name != source]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{k}` {v}" for k, v in new.items())])
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, source):
            found = [main_text(t.decode("utf-8", "replace") if t else "") for t in texts]
            yield with_columns(batch, schema, {to: found, "n_chars": list(map(len, found))}, drop=(source, to, "n_chars"))

    return pages.mapInArrow(task, ddl)
