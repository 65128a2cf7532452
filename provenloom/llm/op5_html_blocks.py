"""Main text of web pages by two-pass block rules.

A small reader cuts the html into blocks at block-level tags and notes for each its characters, words, stop words, link
characters, whether it is a heading, and whether an element around it is named or tagged as page furniture. First pass:
furniture, link-heavy blocks and blocks without letters are bad; long blocks with enough stop words are good; the
others are undecided. Second pass: an undecided block takes the label of the nearest decided blocks before and after it
(where they differ, of the nearer; on a tie the good one); a heading looks at what follows it first.
Names of elements and an ``article`` or ``main`` are clues as well: where one holds a third of the page's text or more,
blocks outside of it are bad and long ones in it good. Names that would throw out all of the running text don't count.
Where no long block has stop words, the language is taken as unknown, and length and links decide.

Defined cases: null or empty html, and pages without a good block, give an empty text; unclosed and nested tags, comments
without an end and stray angle brackets are read as browsers do in the main; repeated rows and ids are rows of their own;
an empty table gives no rows; whole pages are read whatever their length; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Tags of HTML by their role.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template svg iframe object select option textarea button canvas audio video title".split())
RAW = frozenset(("script", "style", "textarea", "title"))
FURNITURE_TAGS = frozenset("nav aside footer menu dialog".split())
FORM_TAGS = frozenset(("form", "fieldset"))  # count as names do: some pages are one form as a whole
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer "
    "header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments disqus reply replies respond response responses discussion pagination pager copyright legal disclaimer toolbar skip search tags metadata byline".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Frequent function words of the languages met.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their "
    "de la le les des et en un une du que qui dans est pour par sur au aux avec pas plus ne ce se sont il elle "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über "
    "el los las y del por con no una su para es al lo como más o pero sus ha me si sin sobre "
    "и в не на что с он как это по но из за от для о же к бы так все его она они мы или у до при также был была было были".split()
)
#: Parts of names that speak for text, whatever else the name holds.
TEXT_NAMES = frozenset("article story entry report content".split())
# a quote counts only behind an equals sign, as browsers read it
SIMPLE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?+)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAME_PART = re.compile(r"[A-Za-z]+")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")

LONG, SHORT = 140, 60
STOP_HIGH, STOP_LOW = 0.10, 0.04
LINKS = 0.35


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    furniture: bool
    named: bool
    content: bool


def clues(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether a tag or its state, and whether its names, say that the element isn't part of the text.

    A class or id says so if half of its parts do and none speaks for text.
    """
    if tag in FURNITURE_TAGS:
        return True, False
    named = tag in FORM_TAGS
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" and m[2] is None or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name == "style" and UNSEEN.search(value):
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = [x.lower() for x in NAME_PART.findall(CAMEL.sub(" ", word))]
                named = named or bool(parts) and 2 * sum(x in FURNITURE_NAMES for x in parts) >= len(parts) and not TEXT_NAMES.intersection(parts)
    return False, named


def tokens(page: str) -> Iterator[re.Match[str]]:
    """Tags, comments and declarations in order, in one scan; the caller may send on the place to go on from.

    A quote that is never closed is no quote, from there on to the page's end: so a tag is read to the end in vain once at most.
    """
    at, pattern = 0, TOKEN
    while (at := page.find("<", at)) >= 0:
        m = pattern.match(page, at)
        if m is None and pattern is TOKEN and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
            pattern = SIMPLE
            m = pattern.match(page, at)
        if m is None:
            if page.find(">", at) < 0:
                return
            at += 1
            continue
        at = (yield m) or m.end()


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. Open elements are kept as a stack of (tag, furniture, content, link, skipped, named)."""
    out: list[Block] = []
    text: list[str] = []
    linked, at, heading = 0, 0, False
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False)]
    # open elements by tag, and for each open block where it stands and what inline elements are open in it
    opened: Counter[str] = Counter()
    frames: list[tuple[int, Counter[str]]] = [(0, Counter())]

    def close() -> None:
        nonlocal linked, heading
        flat = " ".join(entities.unescape("".join(text)).split())
        if flat:
            out.append(Block(flat, linked, heading, stack[-1][1], stack[-1][5], stack[-1][2]))
        text.clear()
        linked, heading = 0, False

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1][4]:
            text.append(piece)
            if stack[-1][3]:
                linked += len(" ".join(entities.unescape(piece).split()))

    def pop(tag: str) -> None:
        """Closes elements up to the last open one of a tag."""
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last in BLOCK:
                frames.pop()
            else:
                frames[-1][1][last] -= 1
            if last == tag:
                return

    scan, jump, endless = tokens(page), None, set()
    while True:
        try:
            m = scan.send(jump)
        except StopIteration:
            break
        jump = None
        take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            take(" ")
            continue
        if tag in BLOCK:
            close()
        if closing:
            # an inline end tag doesn't reach out of its block
            if (opened if tag in BLOCK else frames[-1][1])[tag] > 0:
                pop(tag)
            continue
        if stack[-1][0] == "head" and tag not in HEAD_TAGS:
            pop("head")  # its end tag may be left out
        if tag in VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[frames[-1][0]][0] == tag:
            pop(tag)  # ends an open one of its kind
        _, f, c, a, s, named = stack[-1]
        inside = c or tag in CONTENT_TAGS
        page_header = tag == "header" and not inside
        by_tag, by_name = clues(tag, m[3])
        # names of wrappers end at an article or main
        stack.append((tag, f or page_header or by_tag, inside, a or tag == "a", s or tag in SKIPPED, by_name or named and tag not in CONTENT_TAGS))
        opened[tag] += 1
        if tag in BLOCK:
            frames.append((len(stack) - 1, Counter()))
        else:
            frames[-1][1][tag] += 1
        heading = heading or tag in HEADINGS
        if tag in RAW and tag not in endless:
            if end := RAW_END[tag].search(page, at):
                jump = at = end.start()
            else:
                endless.add(tag)
    take(page[at:])
    close()
    return out


def stop_share(text: str) -> float | None:
    """The share of stop words among a text's words, None without words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else None


def first_pass(b: Block, stops: float | None, has_content: bool, known: bool) -> bool | None:
    """True: good, False: bad, None: undecided. known: whether the page's language is one whose stop words are listed."""
    n, content = len(b.text), has_content and b.content
    if b.furniture or has_content and not b.content or b.linked > LINKS * n:
        return False
    if stops is None:
        return None if content else False
    if n >= LONG:
        return True if stops >= STOP_HIGH or content or not known else None if stops >= STOP_LOW else False
    return True if n >= SHORT and stops >= STOP_HIGH else None


def second_pass(labels: list[bool | None], headings: list[bool]) -> list[bool]:
    """Undecided blocks take the label of their nearest decided neighbours; without any they are bad."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] is not None else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] is not None else after[i + 1]
    out = []
    for i, label in enumerate(labels):
        if label is None:
            left = labels[before[i]] if before[i] >= 0 else None
            right = labels[after[i]] if after[i] < n else None
            if headings[i] and right is not None:
                label = right
            elif left is None or right is None or left == right:
                label = bool(left if right is None else right)
            else:
                label = left if i - before[i] < after[i] - i else right if after[i] - i < i - before[i] else True
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    stops = [stop_share(b.text) for b in found]
    plain = [b.linked <= LINKS * len(b.text) and not b.furniture for b in found]
    dense = [p and (x or 0) >= STOP_LOW and len(b.text) >= SHORT for b, x, p in zip(found, stops, plain, strict=True)]
    of = lambda chosen: sum(len(b.text) for b, yes in zip(found, chosen, strict=True) if yes)
    # names that would throw out all of the running text are names of wrappers
    named = any(d and not b.named for b, d in zip(found, dense, strict=True))
    for b in found:
        b.furniture = b.furniture or named and b.named
    plain = [p and not b.furniture for b, p in zip(found, plain, strict=True)]
    # an article or main that holds next to nothing of the page's text is no clue
    has_content = 3 * of(p and b.content for b, p in zip(found, plain, strict=True)) >= max(1, of(plain))
    known = any((x or 0) >= STOP_LOW for b, x, p in zip(found, stops, plain, strict=True) if p and len(b.text) >= LONG)
    labels = [first_pass(b, x, has_content, known) for b, x in zip(found, stops, strict=True)]
    if True not in labels:
        # a page of short paragraphs: what is undecided is judged as one block; in an article or main nothing speaks against it
        open_ = [i for i, label in enumerate(labels) if label is None and not found[i].heading and stops[i] is not None]
        joined = " ".join(found[i].text for i in open_)
        if has_content or len(joined) >= LONG and (stop_share(joined) or 0) >= STOP_HIGH:
            for i in open_:
                labels[i] = True
    good = second_pass(labels, [b.heading for b in found])
    return "\n\n".join(b.text for b, keep in zip(found, good, strict=True) if keep)


@F.pandas_udf(T.StringType())
def extract(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract("html").alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
