"""Main text of web pages as the maximum-scoring run: words score positive, tags negative, with weights from pages that label themselves."""

from __future__ import annotations

import collections
import functools
import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import dealt

#: Pages that the weights are fitted on, at most.
SAMPLE_PAGES = 2000
#: Log-odds from which a mark of an element decides what its words are, and pages that must show it.
DECIDES, MIN_PAGES = 2.0, 5
#: Odds of names that rule out and of those that only cast doubt, the share of a score that doubt leaves, and how many times the
#: score must be without any guess for guesses to fall.
RULES_OUT, DOUBTS, DOUBT_LEAVES, GUESS_FALLS = -4.0, -1.0, 0.5, 50.0
#: Keys of the counts of words and tags, and of a tag's learned score; the lowest such score; a tag's score within marked content.
WORD, TAG, MOST_TAG, MARKED_TAG = "#word", "#tag", -8.0, -0.02

#: Elements whose content is never text of the page; the first kind holds no elements and ends at its end tag or with the page.
_RAW = "script|style"
_HIDDEN = frozenset("button canvas iframe math noscript object select svg template textarea title".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Elements that part blocks of text.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose names are marks; others are told by their classes, ids and roles alone, as lists and the like stand anywhere.
_SECTIONS = frozenset("article aside dialog footer form header main menu nav section".split())
_CONTENT = frozenset(("article", "main"))
#: What marks mean before any page is seen.
_USUAL = {"article": 4.0, "main": 4.0, "nav": -4.0, "aside": -4.0, "footer": -4.0, "header": -4.0, "form": -4.0, "menu": -4.0, "dialog": -4.0}
#: Words of names of what is no content, and words that go with them: a name of both alone rules out, with any other word (as
#: `social-history`) it only halves the score of the words under it.
_BOILERPLATE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|nav\w*|menu\w*|sidebar|aside|footer|header|masthead|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|signup|share|social|related|recommended|comments?|commentlist|repl(?:y|ies)|respond|breadcrumbs?|pagination|pager|toolbar|widgets?|login|search",
    re.IGNORECASE,
)
_FRAME = frozenset(
    "area article articles aux bar block body bottom box button buttons card center col column container content desktop email entry extra fixed form full global group holder html icon icons info inline inner item items large law layer left legal link links list logo main media meta mobile module more nested news outer overlay page panel posts post primary privacy reading region results right row secondary section site slot small stack sticky story stories text this thread title top unit user wide wrap wrapper".split()
)
_BODY = re.compile(r"(?:^|[-_])(?:article|content|post|entry|story|main)(?:[-_]?(?:body|text|content))?$", re.IGNORECASE)


#: Elements whose end tags may be left out: a tag of the first kind closes an open one of the second, within the third.
_CELLS, _TERMS, _LISTS = ("td", "th"), ("dd", "dt"), ("menu", "ol", "ul")
_CLOSES = {"li": (("li",), _LISTS), "dd": (_TERMS, ("dl",)), "dt": (_TERMS, ("dl",)), "td": (_CELLS, ("table", "tr")), "th": (_CELLS, ("table", "tr")), "tr": (("tr",), ("table",))}
_PARAGRAPH = (("p",), ("caption", "table", "td", "th"))
_IN_TABLE = frozenset(("caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "body", "head", "html"))


def _marks(tag: str, attrs: str) -> list[str]:
    """The marks of an element: its name if it is a section, and its classes, id and role."""
    out = [tag] if tag in _SECTIONS else []
    for a in _ATTR.findall(attrs) if attrs else ():
        out += ["." + x.lower() for x in "".join(a).split()]
    return out


@functools.lru_cache(maxsize=10_000)
def _guess(name: str) -> float:
    """What a class, id or role that no page has taught says by its words."""
    words = [w for w in re.split("[-_]+", name) if w]
    other = [w for w in words if not _BOILERPLATE.fullmatch(w)]
    if len(other) == len(words):
        return 2.5 if _BODY.search(name) else 0.0
    return RULES_OUT if all(w in _FRAME or len(w) < 3 or w.isdigit() for w in other) else DOUBTS


def _odds(mark: str, learned: dict, trust: bool) -> float:
    if mark in learned:
        return learned[mark]
    if mark[0] != ".":
        return _USUAL.get(mark, 0.0)
    odds = _guess(mark[1:])
    return odds if trust or odds > 0 else 0.0


def _verdict(above: float, marks: list[str], learned: dict, trust: bool) -> float:
    """What marks decide under what decided above them: an inner mark overrides outer ones, but nothing inside content that
    was ruled out comes back, as replies under an article are no article."""
    odds = [_odds(m, learned, trust or above > 0) for m in marks]
    x = (min(odds) if min(odds) <= -DECIDES else max(odds)) if odds else 0.0
    if above == -math.inf or abs(x) < DECIDES:
        return above
    return -math.inf if above > 0 > x else x


def segments(html: str, learned: dict[str, float], trust: bool = True):
    """(kind, value, open) in page order: "tag" with a name at each tag, "text" with raw text; open is the stack of (name, marks down to it, verdict) above it, of all
    elements. trust: whether the usual meaning of names for what is no content counts outside of content."""
    stack: list[tuple[str, frozenset[str], float]] = []
    n_open: collections.Counter = collections.Counter()  # so that an end tag without a beginning costs no search

    def shut(names: tuple, within: tuple) -> None:
        """Close the innermost open element of one of the names, with all in it, unless one of within lies between."""
        if not any(n_open[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                for x in stack[i:]:
                    n_open[x[0]] -= 1
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            yield "text", html[at : m.start()], stack
        at = m.end()
        close, name, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        yield "tag", name, stack
        if name in _VOID:
            continue
        if close:
            shut((name,), _CLOSES[name][1] if name in _CLOSES else _PARAGRAPH[1] if name == "p" else ())
        elif not attrs.endswith("/") or name in _BLOCKS or name in _HIDDEN and name not in ("math", "svg"):
            if name in _BLOCKS and name not in _IN_TABLE:
                shut(*_PARAGRAPH)
            if name in _CLOSES:
                shut(*_CLOSES[name])
            marks = _marks(name, attrs)
            above, odds = (stack[-1][1], stack[-1][2]) if stack else (frozenset(), 0.0)
            stack.append((name, above if above.issuperset(marks) else above.union(marks), -math.inf if name in _HIDDEN else _verdict(odds, marks, learned, trust)))
            n_open[name] += 1
    if at < len(html):
        yield "text", html[at:], stack


def counts(html: str) -> dict[str, tuple[int, int]]:
    """Words inside and outside of the article, by the marks open above them, of a page that labels its article; else nothing."""
    out: dict[str, list[int]] = {}
    labelled = False
    for kind, value, stack in segments(html, {}):
        if kind == "text" and (n := len(value.split())):
            marks = stack[-1][1] if stack else frozenset()
            inside = bool(marks & _CONTENT) and not any(_USUAL.get(x, 0) < 0 for x in marks)
            labelled |= inside
            for m in marks:
                out.setdefault(m, [0, 0])[not inside] += n
    return {k: (a, b) for k, (a, b) in out.items()} if labelled else {}


def _tokens(html: str) -> list[int]:
    """Words and tags inside, words and tags outside of the article of a page that labels its article; what is never text counts nowhere."""
    n = [0, 0, 0, 0]
    for kind, value, stack in segments(html, {}):
        marks, odds = (stack[-1][1], stack[-1][2]) if stack else (frozenset(), 0.0)
        inside = bool(marks & _CONTENT) and not any(_USUAL.get(x, 0) < 0 for x in marks)
        if odds > -math.inf or not inside:
            n[2 * (not inside) + (kind == "tag")] += 1 if kind == "tag" else len(value.split())
    return n


def fit_weights(pages: DataFrame, id_col: str, html_col: str, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds of the marks that decide, and the score of a tag (key TAG) where a word's is 1, from a bounded sample of pages: those of least hash of their id.

    Pages that hold an article or main element label their own words. A mark that few pages show is left to what is usual. The
    score of a tag is the ratio of two log-odds: of meeting a tag, and of meeting a word, inside of articles against outside.
    """
    ids = pages.select(F.col(id_col).alias("_ll_id")).distinct().orderBy(F.xxhash64(F.lit(8), "_ll_id")).limit(sample_pages)
    sample = pages.join(F.broadcast(ids), F.col(id_col) == F.col("_ll_id"), "left_semi").select(F.col(html_col).cast("string").alias("html"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for h in pdf["html"].dropna():
                if found := counts(h):
                    rows += [(m, a, b) for m, (a, b) in found.items()]
                    words_in, tags_in, words_out, tags_out = _tokens(h)
                    rows += [(WORD, words_in, words_out), (TAG, tags_in, tags_out)]
            yield pd.DataFrame(rows, columns=["mark", "inside", "outside"])

    found = dealt(sample).mapInPandas(run, "mark string, inside long, outside long").groupBy("mark").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"), F.count(F.lit(1)).alias("n"))
    rows = {r["mark"]: r for r in found.where(F.col("n") >= MIN_PAGES).orderBy(F.desc("n"), "mark").limit(10_000).collect()}
    word, tag = rows.pop(WORD, None), rows.pop(TAG, None)
    odds = {m: math.log((r["a"] + 0.5) / (r["b"] + 0.5)) for m, r in rows.items()}
    out = {m: x for m, x in odds.items() if abs(x) >= DECIDES}
    if word and tag:
        all_in, all_out = word["a"] + tag["a"] + 1, word["b"] + tag["b"] + 1
        of_word, of_tag = (math.log((r["a"] + 0.5) / all_in) - math.log((r["b"] + 0.5) / all_out) for r in (word, tag))
        if of_word > 0 > of_tag:  # otherwise articles are no wordier than the rest, and what is usual stands
            out[TAG] = max(of_tag / of_word, MOST_TAG)
    return out


def best_run(scores) -> tuple[int, int]:
    """(start, end) of the run of greatest sum, the first of equals; (0, 0) if no sum is positive. One linear scan."""
    best = total = 0.0
    start, span = 0, (0, 0)
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(html: str, learned: dict[str, float]) -> str:
    """The text of the best-scoring run of a page, cleaned of what its marks rule out.

    A word under a mark that decides for content scores 1, one that no mark decides on scores 1 too (half of it under a name that
    casts doubt), unless the page labels its article elsewhere, then -1; a tag scores what was learned (-1 before), and next to
    nothing within marked content. What is ruled out scores nothing and is not in the text: sections and learned marks, an
    article's own header too, and names that say so by all their words. Such a name that no page taught is a guess: where
    the page without guesses scores GUESS_FALLS times as high, they fall. Blocks are cut at block elements; a line break is
    a blank.
    """
    score, text, most = _main_text(html, learned, True)
    if most > GUESS_FALLS * score:
        freely, other, _ = _main_text(html, learned, False)
        if freely > GUESS_FALLS * score:
            return other
    return text


def _main_text(html: str, learned: dict[str, float], trust: bool) -> tuple[float, str, int]:
    """Score and text of the best run, and the words of the page if a guess ruled any out (no run without guesses scores more), else 0."""
    runs, scores = [], []  # (marked, in doubt, piece of text, or None at the border of a block)
    own, guessed = False, 0
    doubted: dict[frozenset, bool] = {}
    rules: dict[frozenset, bool] = {}

    def any_guess(marks: frozenset, odds: float, known: dict) -> bool:
        if marks not in known:
            known[marks] = any(m[0] == "." and m not in learned and _guess(m[1:]) == odds for m in marks)
        return known[marks]

    for kind, value, stack in segments(html, learned, trust):
        marks, odds = (stack[-1][1], stack[-1][2]) if stack else (frozenset(), 0.0)
        if odds <= -DECIDES:
            if trust and kind == "text" and any_guess(marks, RULES_OUT, rules):
                guessed += len(value.split())
            if kind == "tag" and value in _BLOCKS:
                runs.append((True, False, None, True))
            continue
        doubt = trust and odds == 0 and any_guess(marks, DOUBTS, doubted)
        if kind == "tag":
            runs.append((odds > 0, doubt, None if value in _BLOCKS else " " if value == "br" else "", True))
        else:
            runs.append((odds > 0, doubt, value, False))
            own |= odds > 0 and not value.isspace()
    of_tag = learned.get(TAG, -1.0)
    for marked, doubt, value, tag in runs:
        n = 1 if tag else len(value.split())
        word = 1 if marked else -1 if own else DOUBT_LEAVES if doubt else 1
        scores.append(n * (MARKED_TAG if marked else of_tag) if tag else n * word)
    start, end = best_run(scores)
    most = guessed and guessed + sum(len(x[2].split()) for x in runs if not x[3])
    blocks, now = [], []
    for marked, _, value, _ in runs[start:end]:
        if value is None:
            blocks.append("".join(now))
            now = []
        elif marked or not own or value == " ":
            now.append(value)
    blocks.append("".join(now))
    clean = (" ".join(unescape(b).split()) for b in blocks)
    return sum(scores[start:end]), "\n".join(b for b in clean if b), most


def extract(df: DataFrame, learned: dict[str, float], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """df with the main text of each page, from its whole html; null and empty pages and pages without words have the empty text.

    Of runs that score alike the first is taken. Equal pages get equal texts, rows that repeat stay; a column of the text's
    name is replaced, all others stay. An empty table gives an empty table.
    """
    sent = df.sparkSession.sparkContext.broadcast(learned)  # 10,000 marks at most

    @F.pandas_udf("string")
    def text(pages):
        return pages.map(lambda h: main_text(h, sent.value) if h else "").astype(object)

    return dealt(df).withColumn(text_col, text(F.col(html_col).cast("string")))
