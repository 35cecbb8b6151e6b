"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of tags and words. Words score positive and tags negative; how much,
depends on where they stand, and is learned from pages that mark their article
(``<article>`` or ``<main>``): the log-odds of standing inside it, for tags by name and for
words by the elements they stand in. One linear scan finds the contiguous run of tokens
with the largest sum. Inside that run, words of menus, forms, notices and the like are
left out, unless such an element wraps the page.

Weights come from at most ``LABELLED_PAGES`` marked pages of up to ``LABELLED_CHARS``
characters, chosen by a hash of the page, and are a few numbers per tag name. Pages are independent: nothing else is shuffled.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import hashed_sample, short_batches, table

#: Pages that weights are learned from, and the longest of them: what is sent to the driver has a bound in bytes too.
LABELLED_PAGES, LABELLED_CHARS = 400, 1_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

# Element names of HTML, and words that mark parts of a page which are not its article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
NEVER = frozenset("head nav footer aside form button select menu dialog script style noscript template svg iframe object".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social newsletter subscribe signup login "
    "comment comments disqus replies footer masthead header copyright toolbar pagination".split()
)
#: First parts of names that say how a page is laid out ("has-sidebar"), and those of an article's own heading block ("entry-header").
LAYOUT = frozenset("has with without no is not layout".split())
OWN_HEADER = frozenset("article entry post story".split())
#: Elements of running text. Within a marked article they are left out only if they are called adverts or the like.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split()) | INLINE
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo share sharing social newsletter subscribe related recommended".split())
#: What shows that an excluded element may be a wrapper of the page.
CORE = frozenset(("article", "main", "h1"))
REPLACED = frozenset("script style noscript template svg iframe textarea title".split())


class Place(NamedTuple):
    """Where a token stands: what its innermost open element has or inherits."""

    name: str = ""
    block: str = ""  # the innermost element that is not inline
    link: bool = False
    article: bool = False
    excluded: bool = False  # no part of an article, by an element's name or by what its attributes call it
    root: int = 0  # the outermost element that excludes: its number among start tags, negative if its name alone does, but for forms
    form: bool = False  # whether that element is a form

    @property
    def feature(self) -> str:
        return f"{self.block}{'+a' if self.link else ''}{'-' if self.excluded else ''}"


_TOP = Place()


def called_boilerplate(name: str, attributes: str, article: bool) -> bool:
    """Whether an element's attributes call it something else than an article's part."""
    if name in ("html", "body", "article", "main"):
        return False
    telling = ADVERTS if article and name in TEXT else BOILERPLATE
    for found in _MARKS.findall(attributes):
        for word in "".join(found).lower().split():
            parts = [p for p in re.split(r"[^a-z]+", word) if p]
            if parts and parts[0] not in LAYOUT and telling.intersection(parts) - ({"header"} if parts[0] in OWN_HEADER else set()):
                return True
    return False


def wrappers(page: str) -> frozenset[int]:
    """Excluded elements that wrap the page, by their numbers: they have most of its words outside links, and its article,
    main part or first heading, or they are forms. What they wrap is judged by itself."""
    kept: frozenset[int] = frozenset()
    for _ in range(4):
        words: Counter[int] = Counter()
        holds: set[int] = set()
        for kind, value, at in tokens(page, kept):
            if kind == "words" and not at.link:
                words[at.root] += len(value.split())
            elif kind == "open" and at.root > 0 and (at.form or value in CORE):
                holds.add(at.root)
        new = {r for r in holds if 2 * words[r] > sum(words.values())}
        if not new:
            break
        kept |= new
    return kept


def tokens(page: str, kept: frozenset[int] = frozenset()) -> Iterator[tuple[str, str, Place]]:
    """(kind, value, place): ``open``, ``close`` or ``words``. Elements of the numbers ``kept`` exclude nothing.

    Raw elements, comments and declarations give nothing. A tag that does not end, or has ``<``
    outside quotes, is text. An element costs one small record however deep it stands.
    """
    stack: list[Place] = []
    open_: Counter[str] = Counter()
    number = 0

    def leave() -> str:
        name = stack.pop().name
        open_[name] -= 1
        return name

    for m in _TOKEN.finditer(page):
        raw, slash, name, attributes, words = m.groups()
        at = stack[-1] if stack else _TOP
        if words is not None:
            yield "words", words, at
        elif name is not None:
            name = name.lower()
            if slash:
                if name in VOID:
                    yield "open", name, at
                    continue
                if open_[name]:
                    while leave() != name:
                        pass
                yield "close", name, stack[-1] if stack else _TOP
                continue
            if name not in INLINE and name not in VOID:
                while stack and (stack[-1].name in INLINE or stack[-1].name == "p"):
                    leave()
                at = stack[-1] if stack else _TOP
            if name not in VOID:
                number += 1
                by_name = (name in NEVER and name != "form") or (name == "header" and not at.article)
                never = number not in kept and (by_name or name == "form" or called_boilerplate(name, attributes, at.article))
                root, form = (at.root, at.form) if at.excluded or not never else (-number if by_name else number, name == "form")
                inner = Place(name, at.block if name in INLINE else name, at.link or name == "a", at.article or name in ("article", "main"), at.excluded or never, root, form)
                stack.append(inner)
                open_[name] += 1
                yield "open", name, inner._replace(excluded=at.excluded)
            else:
                yield "open", name, at
        elif raw is not None:
            yield "open", raw.lower(), at._replace(excluded=True)


def learn(pages: list[str]) -> dict[str, float]:
    """Log-odds of standing inside a marked article, by feature, between -4 and 4."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        for kind, value, at in tokens(page, wrappers(page)):
            n = len(value.split()) if kind == "words" else 1
            key = f"words {at.feature}" if kind == "words" else f"{kind} {value}"
            (inside if at.article and not at.excluded else outside)[key] += n
    return {k: max(-4.0, min(4.0, math.log((inside[k] + 0.5) / (outside[k] + 0.5)))) for k in inside.keys() | outside.keys()}


def score(kind: str, value: str, at: Place, weights: dict[str, float]) -> float:
    """Words: their number times a weight that is positive outside excluded parts unless learned otherwise; tags: between -1 and -0.01."""
    if kind == "words":
        w = weights.get(f"words {at.feature}", -1.0 if at.excluded or at.link else 0.5)
        return len(value.split()) * (min(w, -0.5) if at.excluded else w)
    unknown = 0.45 if value in INLINE and value != "a" else 0.0
    return max(-1.0, min(-0.01, weights.get(f"{kind} {value}", unknown) - 0.5))


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The scan keeps the words of the run at hand and, where that has been best so far, how many of them count."""
    if not page:
        return ""
    best, total = 0.0, 0.0
    run: list[str] = []
    text = ""
    counted = 0  # pieces of ``run`` up to the best end, 0 if the best run is an earlier one
    for kind, value, at in tokens(page, wrappers(page)):
        if total <= 0:
            if counted:
                text, counted = "".join(run[:counted]), 0
            total, run = 0.0, []
        total += score(kind, value, at, weights)
        if kind == "words":
            if not at.excluded:
                run.append(html_lib.unescape(value))
        elif value not in INLINE:
            run.append("\n")
        if total > best:
            best, counted = total, len(run)
    if counted:
        text = "".join(run[:counted])
    return " ".join(text.split())


def learned_weights(pages: DataFrame, html_col: str = "html", max_pages: int = LABELLED_PAGES) -> dict[str, float]:
    marked = pages.select(F.col(html_col).alias("h")).where((F.length("h") <= LABELLED_CHARS) & F.col("h").rlike(r"(?i)<(article|main)\b"))
    return learn(sorted(r["h"] for r in hashed_sample(marked, F.col("h"), max_pages).collect()))


def extractor(weights: dict[str, float]):
    @pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return extract


def extract_main_text(pages: DataFrame, html_col: str = "html", into: str = "main_text", max_pages: int = LABELLED_PAGES) -> DataFrame:
    """``pages`` with the main text in ``into``, which must be a new name.

    Null and empty pages, and pages without words of positive score, have an empty text. If
    no page marks its article, words count 0.5 and tags -0.5. Of two runs with the same sum,
    the first is taken. Repeated pages give repeated rows.
    """
    if into in pages.columns:
        raise ValueError(f"column {into} exists")
    short_batches(pages.sparkSession)
    return pages.withColumn(into, extractor(learned_weights(pages, html_col, max_pages))(F.col(html_col)))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length; null and empty pages have an empty text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars")
    )
