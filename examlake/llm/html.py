"""Main text of web pages: the contiguous region of the largest score, words positive and tags negative.

A page is a run of tags and texts. Each word scores +1, each tag its weight, which is below zero always; the region with the
largest sum is found in one pass. Containers that are never content (menus, forms, asides, scripts, comments and the like)
count nothing and are left out of the region. Weights are learned by an averaged, projected structured perceptron on labelled pages: pages
that mark their content themselves (one <article> or one <main>). Up to ``SAMPLE`` of them of at most ``LARGEST`` characters, by a hash of
their text, are used, a documented bound; tags that never occurred there weigh ``UNSEEN``.

Pages are read in one pass whatever they hold: a quote opens a value only where one closes it, and what is looked for once in
vain is not looked for again. Elements close as HTML says (a new <p> ends the open one, the end of a container ends all in
it). A container of a never kind that nothing closes reaches to the next block only, and one that holds the page's <main> or
only <article> is none, so no slip in the markup loses the rest of a page.

A class, id or role makes a container a never kind where it is one of ``NEVER_WORDS``, alone or with words of place and form only
("ad-box", "site-footer"); with any other word it says something of the page ("has-sidebar", "comments-open", "related-work") and counts for
nothing. On a page without its <main> or only <article>, a form or a named container that holds four fifths of the words outside of other elements of a
never kind is the page's frame, and stays; only one of reader comments never does.

Defined results: a null or empty page, and one without words, has the empty text; equal scores take the first and
shortest region; repeated rows give repeated rows; a column named text is replaced, other columns stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.shared import slices, smallest, text_of, with_results

SAMPLE, ROUNDS, UNSEEN, MARGIN = 1500, 10, -1.0, 0.5
#: Characters of the longest page that the weights are learned from.
LARGEST = 100_000
#: The most that a tag may weigh.
HIGHEST = -0.05
#: White space of HTML texts: that of words, and the no-break space that &nbsp; gives.
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: What follows a tag's name where every value is plain; and what may end a tag or begin a value elsewhere.
_PLAIN = re.compile(r"(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+>")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Elements that stand inside a line of text, that have no end tag, whose content is no markup, and that are never content.
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?![a-zA-Z0-9-])[^>]*+>", re.IGNORECASE) for tag in "script style textarea title noscript iframe".split()}
NEVER = set("nav header footer aside form button dialog menu select template svg textarea title noscript iframe".split())
NEVER_WORDS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer menu nav navbar navigation newsletter notice popup promo related replies share sharing sidebar social sponsored subscribe toolbar widget widgets".split())
FORM_WORDS = set("area bar block bottom box buttons consent container footer form global group header holder inner item items left links list main modal navigation outer panel placeholder posts primary region right rail row secondary section site slot stories strip thread top unit wrap wrapper".split())
COMMENTS = set("comment comments disqus replies".split())
_TOKEN, _WORD = re.compile(r"\S+"), re.compile(r"[a-z]+")
# Elements that may end without an end tag, the start tags that end each, and within what they are looked for.
_BLOCKS = "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
_ENDED_BY = {"p": _BLOCKS, "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody tfoot thead", "td": "td th tr tbody tfoot thead", "th": "td th tr tbody tfoot thead", "thead": "tbody tfoot", "tbody": "tbody tfoot", "tfoot": "tbody", "option": "option optgroup"}
_WITHIN = {"p": "td th caption button", "li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select"}
_ENDS = {tag: [old for old, by in _ENDED_BY.items() if tag in by.split()] for by in _ENDED_BY.values() for tag in by.split()}
_TABLE = "table thead tbody tfoot tr td th caption".split()

Part = tuple[str, str, str]


def _tag_end(html: str, at: int) -> int:
    """The place behind the > that ends the tag; -1 where none does. A quote that no well-placed one closes is a character like others."""
    while m := _STOP.search(html, at):
        at = m.end()
        if m[0] == ">":
            return at
        close = html.find(m[0], at)
        if close >= 0 and html[close + 1 : close + 2] in ("", " ", "\n", "\t", "\r", "\f", "/", ">"):
            at = close + 1
    return -1


def parts(html: str) -> list[Part]:
    """(kind, name, value): ("text", "", text) and ("open" or "close", tag, class, id and role names), in one pass."""
    out: list[Part] = []
    at, text_from, size = 0, 0, len(html)
    gone: set[str] = set()  # what is not to come any more
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= size:
            break
        begin, follow = at, html[at + 1]
        named = None
        if follow in "!?":
            end = -1
            if html.startswith("<!--", at) and "-->" not in gone:
                end = html.find("-->", at + 2) + 3
                if end == 2:
                    gone.add("-->")
                    end = -1
            if end < 0:
                end = html.find(">", at) + 1
                if not end:
                    break
        elif named := _NAME.match(html, at + 1):
            if m := _PLAIN.match(html, named.end()):
                end = m.end()
            else:
                end = -1 if "quoted" in gone else _tag_end(html, named.end())
                if end < 0:
                    gone.add("quoted")
                    end = html.find(">", named.end()) + 1
                    if not end:
                        break
        else:
            at += 1
            continue
        if begin > text_from:
            out.append(("text", "", html[text_from:begin]))
        if named:
            name, closes = named[2].lower(), bool(named[1])
            if not closes and name in RAW and name not in gone:
                if close := RAW[name].search(html, end):
                    end = close.end()
                    named = None
                elif name in ("script", "style"):
                    end, named = size, None
                else:
                    gone.add(name)
            if named:
                rest = "" if closes else html[named.end() : end - 1]
                out.append(("close" if closes else "open", name, " ".join(a or b or c for a, b, c in _NAMED.findall(rest)) if "=" in rest else ""))
        at = text_from = end
    if text_from < size:
        out.append(("text", "", html[text_from:]))
    return out


def _covered(found: list[tuple[int, int, int]], n: int) -> list[int]:
    """What each place adds to the number of containers it lies in."""
    change = [0] * (n + 1)
    for begin, end, _ in found:
        change[begin] += 1
        change[end] -= 1
    return change


def never_named(value: str) -> int:
    """0 if a container's class, id and role names do not make it a never kind, 1 if they do, 2 if it is one of reader comments."""
    kind = 0
    for token in _TOKEN.findall(value.lower()):
        own = set(_WORD.findall(token))
        if own & NEVER_WORDS and own <= NEVER_WORDS | FORM_WORDS:
            kind = max(kind, 2 if own & COMMENTS else 1)
    return kind


def skipped(page: list[Part]) -> list[bool]:
    """For each part, whether it lies in a container that is never content."""
    stack: list[tuple[str, int, int]] = []  # name, place, and 0: content, 1: never, unless it is the page's frame, 2: never
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
    found: list[tuple[int, int, int]] = []
    loose: list[tuple[int, int]] = []

    def top(names) -> int:
        return max((open_at[n][-1] for n in names if open_at[n]), default=-1)

    def pop_to(depth: int, i: int, by: str = "") -> None:
        while len(stack) > depth:
            name, begin, never = stack.pop()
            open_at[name].pop()
            own = name == by and len(stack) == depth
            if never and (own or name in _ENDED_BY):
                found.append((begin, i + own, never))
            elif never:
                loose.append((begin, never))

    blocks = []
    for i, (kind, name, value) in enumerate(page):
        if kind == "text" or name in INLINE:
            continue
        blocks.append(i)
        if kind == "open":
            for old in _ENDS.get(name, ()):
                if (depth := top((old,))) > top(_WITHIN.get(old, "table").split()):
                    pop_to(depth, i)
            if name not in VOID:
                open_at[name].append(len(stack))
                named = never_named(value) if value and name not in ("body", "html", "article", "main") else 0
                stack.append((name, i, 2 if name in NEVER and name != "form" else max(named, int(name == "form"))))
        else:
            depth = top((name,))
            if depth >= 0 and (name in _TABLE or depth > top(("td", "th", "caption"))):
                pop_to(depth, i, name)
    pop_to(0, len(page))
    for begin, never in loose:
        after = bisect_right(blocks, begin)
        found.append((begin, blocks[after] if after < len(blocks) else len(page), never))
    marked = [own[0] for tag in ("article", "main") if len(own := [i for i, (kind, name, _) in enumerate(page) if kind == "open" and name == tag]) == 1]
    found = [(begin, end, never) for begin, end, never in found if not any(begin < x < end for x in marked)]
    change = _covered([x for x in found if x[2] == 2], len(page))
    if weak := [x for x in found if x[2] == 1]:
        upto, hidden = [0], 0
        for (kind, _, value), x in zip(page, change):
            hidden += x
            upto.append(upto[-1] + (len(value.split()) if kind == "text" and not hidden else 0))
        small = [x for x in weak if marked or 5 * (upto[x[1]] - upto[x[0]]) <= 4 * upto[-1]]
        change = [a + b for a, b in zip(change, _covered(small, len(page)))]
    out, depth = [], 0
    for x in change[:-1]:
        depth += x
        out.append(depth > 0)
    return out


def features(page: list[Part], never: list[bool]) -> list[tuple[str, int]]:
    """For each part its tag feature ("" for texts) and its words; what is never content counts neither for nor against a region."""
    return [("", 0 if out else len(v.split())) if out or kind == "text" else (("/" if kind == "close" else "") + name + (f".{v.split()[0].lower()}" if v.split() else ""), 0) for (kind, name, v), out in zip(page, never, strict=True)]


def best_region(scored: list[float]) -> tuple[int, int]:
    """The contiguous run of the largest sum (end exclusive; empty if none is positive), in one pass."""
    best, run, begin, region = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scored):
        if run <= 0:
            run, begin = 0.0, i
        run += x
        if run > best:
            best, region = run, (begin, i + 1)
    return region


def scores(feats: list[tuple[str, int]], weight: dict[str, float]) -> list[float]:
    return [float(n) if not tag else weight.get(tag, UNSEEN) for tag, n in feats]


def labelled_region(page: list[Part]) -> tuple[int, int] | None:
    """The inside of the page's only <article>, or else only <main>; None where there is none."""
    for tag in ("article", "main"):
        opened = [i for i, (kind, name, _) in enumerate(page) if kind == "open" and name == tag]
        if len(opened) == 1:
            end = next((i for i, (kind, name, _) in enumerate(page) if kind == "close" and name == tag), len(page))
            return opened[0] + 1, end
    return None


def learned(pages: list[str]) -> dict[str, float]:
    """Averaged perceptron with a margin: what the right region holds more often than the best one gains weight, up to ``HIGHEST``, and the reverse; while training, parts of the right region count less and others more."""
    examples = []
    for html in pages:
        page = parts(html)
        if region := labelled_region(page):
            examples.append((features(page, skipped(page)), region))
    weight: dict[str, float] = defaultdict(lambda: UNSEEN)
    total: dict[str, float] = defaultdict(float)
    step = 1
    for _ in range(ROUNDS):
        for feats, (a, b) in examples:
            inside = lambda i, p, q: p <= i < q
            x, y = best_region([v + MARGIN * max(n, 1) * (-1 if inside(i, a, b) else 1) for i, (v, (_, n)) in enumerate(zip(scores(feats, weight), feats, strict=True))])
            if (x, y) != (a, b):
                for i, (tag, _) in enumerate(feats):
                    if tag and (change := inside(i, a, b) - inside(i, x, y)):
                        change = min(weight[tag] + change, HIGHEST) - weight[tag]
                        weight[tag] += change
                        total[tag] += step * change
            step += 1
    return {tag: weight[tag] - total[tag] / step for tag in weight}


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Tag weights from at most ``sample`` labelled pages, gathered in one task; what comes back is one number for each tag seen there."""
    marked = pages.select(html_col).filter(F.lower(F.col(html_col)).rlike("<(article|main)[ >]") & (F.char_length(html_col) <= LARGEST))
    chosen = smallest(marked.withColumn("at", F.xxhash64(html_col)), "at", sample)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        weight = learned(list(rows.sort_values("at")[html_col]))
        return pd.DataFrame({"tag": list(weight), "weight": list(weight.values())})

    return {r["tag"]: r["weight"] for r in chosen.groupBy().applyInPandas(fit, "tag string, weight double").collect()}


def main_text(html: str, weight: dict[str, float]) -> str:
    page = parts(html)
    never = skipped(page)
    a, b = best_region(scores(features(page, never), weight))
    blocks: list[list[str]] = [[]]
    for i in range(a, b):
        kind, name, value = page[i]
        if kind == "text":
            if not never[i]:
                blocks[-1].append(value)
        elif name not in INLINE and blocks[-1]:
            blocks.append([])
    lines = (_SPACE.sub(" ", unescape("".join(x))).strip() for x in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, weight: dict[str, float], html_col: str = "html") -> DataFrame:
    """``pages`` with ``html_col`` replaced by text."""
    rows, schema = with_results(pages, "text string", without=html_col)
    keep = [f.name for f in schema.fields[:-1]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = [main_text(h.as_py(), weight) for h in text_of(batch, html_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(scan, schema)
