"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive and tags negative; a linear scan finds the
contiguous region with the largest sum, and its text is the article. Weights come from labelled pages, those
that mark one article element: how often words under an element, and tags, fall inside and outside, against how often
all do where most lie outside. Elements that lie outside (menus, adverts, ...) or have a usual name of page
furniture are left out, in the region too, each at one small cost (:data:`FURNITURE_COST`) however long it is; so
an advert does not cut an article in two. Elements that hold the article of labelled pages are never furniture,
and a learned article overrides what is around it. Tags inside an article cost next to nothing, tags around it much.

The fit takes at most :data:`SAMPLE_PAGES` pages of :data:`SAMPLE_CHARS` characters; extraction is one pass over
whole pages. Null and empty html, and pages without words, have the empty text. Tags that do not close,
stray brackets, broken entities and a page cut off anywhere are read as far as they go.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import query, table

SAMPLE_PAGES, SAMPLE_CHARS = 1_500, 15_000_000
#: what a whole furniture element costs, in words, and the share of an element's pages where it must hold the article
FURNITURE_COST, HOLDS, HOLDS_NAMED = 0.25, 0.1, 0.5
_PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b.*?(?:</\1\s*>|\Z)|<[!/?a-z](?:[^>"']|"[^"]*"|'[^']*')*(?:>|\Z)|<[!/?a-z][^>]*(?:>|\Z)|[^<]+|<""",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: fixed names: elements that do not break a block, elements without an end tag, and parts of lists and tables
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PARTS = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th".split())
#: fixed names of elements that hold whole pages
_PAGE = frozenset("html body main".split())
#: fixed names of page furniture: elements, and words of a class, an id or a role
_FURNITURE = frozenset("nav header footer aside form title head dialog menu select button figcaption".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar side cookie cookies consent notice alert popup modal form search subscribe newsletter share social related recommended comment comments reply replies respond disqus".split()
)


def _element(piece: str) -> tuple[str, str, bool] | None:
    """(name, signature, closing) of a tag."""
    m = _TAG.match(piece)
    if not m:
        return None
    name = m[2].lower()
    if m[1]:
        return name, "/" + name, True
    named = [w for x in _NAME.findall(piece) for w in re.split(r"[\s_-]+", "".join(x).lower()) if w]
    return name, ".".join([name, *sorted(set(named))[:4]]), False


def parsed(page: str) -> Iterator[tuple[str, str, tuple[str, ...], bool]]:
    """(tag or text, signature or text, signatures of the open elements, whether a block ends)."""
    stack: list[tuple[str, str]] = []
    for m in _PIECE.finditer(page):
        piece = m[0]
        if piece[0] != "<" or piece == "<":
            yield "text", piece, tuple(s for _, s in stack), False
            continue
        if piece.startswith("<!--"):
            continue
        if m[1]:
            yield "tag", m[1].lower(), tuple(s for _, s in stack), True
            continue
        e = _element(piece)
        if e is None:
            continue
        name, signature, closing = e
        around = tuple(s for _, s in stack)
        if name not in _INLINE and name not in _VOID and name not in _PARTS:
            if closing:
                if any(n == name for n, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            elif not piece.endswith("/>"):
                if name == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                stack.append((name, signature))
                around = tuple(s for _, s in stack)
        if name not in _INLINE:
            yield "tag", signature, around, True


def _base(signature: str) -> str:
    return signature.split(".")[0]


def _from_article(around: tuple[str, ...]) -> tuple[str, ...]:
    """The open elements from the innermost article on, or none."""
    at = max((i for i, s in enumerate(around) if _base(s) == "article"), default=len(around))
    return around[at:]


def fit(pages: list[str]) -> dict:
    """Weights of words by element and of tags, and the elements that hold articles."""
    words, tags, total = (Counter(), Counter()), (Counter(), Counter()), [Counter(), Counter()]
    holds, seen = Counter(), Counter()
    for page in pages:
        if len(re.findall(r"<article\b", page, re.I)) != 1:
            continue
        inside, open_here, met = 0, set(), set()
        for kind, what, around, _ in parsed(page):
            met.update(around)
            if kind == "tag":
                base = _base(what)
                if base == "/article":
                    inside = 0
                own = base in ("article", "/article")
                if own or not any(map(_furniture, _from_article(around) if inside else around)):
                    tags[0 if own else inside][what] += 1
                    total[1][0 if own else inside] += 1
                if base == "article":
                    inside = 1
                    open_here.update(around[:-1])
            elif n := len(what.split()):
                within = int(bool(inside) and not any(map(_furniture, _from_article(around))))
                for s in set(around):
                    words[within if _base(s) != "article" else inside][s] += n
                total[0][within] += n
        holds.update(open_here)
        seen.update(met)

    def weigh(counts: tuple[Counter, Counter], all_: Counter) -> dict[str, float]:
        """Log odds of lying inside; where most of all lies outside, against that."""
        usual = min(0.0, math.log((all_[1] + 0.5) / (all_[0] + 0.5)))
        return {k: math.log((counts[1][k] + 0.5) / (counts[0][k] + 0.5)) - usual for k in {*counts[0], *counts[1]}}

    wrappers = {s for s, n in holds.items() if n >= (HOLDS_NAMED if _furniture(s) else HOLDS) * seen[s]}
    return {"words": weigh(words, total[0]), "tags": weigh(tags, total[1]), "wrappers": wrappers}


def _furniture(signature: str) -> bool:
    name, *named = signature.lstrip("/").split(".")
    return name not in _PAGE and (name in _FURNITURE or not _FURNITURE_WORDS.isdisjoint(named))


def left_out(around: tuple[str, ...], model: dict) -> bool:
    """Whether an open element is page furniture; a learned article overrides what is around it."""
    own = _from_article(around)
    if own and (_furniture(own[0]) or model["words"].get(own[0], 0.0) <= 0):
        own = ()
    return any(s not in model["wrappers"] and (_furniture(s) or _base(s) not in _PAGE and model["words"].get(s, 0.0) < -1) for s in own or around)


def tag_weight(signature: str, around: tuple[str, ...], model: dict) -> float:
    own = _from_article(around)
    if own and _base(signature) not in ("article", "/article") and model["words"].get(own[0], 0.0) > 0:
        return -0.02
    w = model["tags"].get(signature)
    if w is None:
        w = -3.0 if _furniture(signature) else 1.0
    return -0.02 if w > 0 else 4 * max(w, -6.0) - 0.02


def extract(page: str, model: dict) -> str:
    """Text of the best region; of equal sums the first and then the longest."""
    pieces, sums, out, known = [], [], False, {}
    for kind, what, around, _ in parsed(page):
        if around not in known:
            known[around] = left_out(around, model)
        before, out = out, known[around]
        text = entities.unescape(what) if kind == "text" else " "
        pieces.append((text, kind == "tag" or not out))
        if out:
            sums.append(0.0 if before else -FURNITURE_COST)
        else:
            sums.append(float(len(text.split())) if kind == "text" else tag_weight(what, around, model))
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(sums):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, best_from, best_to = total, start, i + 1
    return " ".join("".join(t for t, keep in pieces[best_from:best_to] if keep).split())


def learned(pages: DataFrame) -> dict:
    """Weights from a bounded sample of pages in hash order."""
    rows = pages.select(F.xxhash64(F.lit("page"), "page_id").alias("o"), F.length("html").alias("n"), "html").filter(F.col("html").isNotNull())
    left, chosen = SAMPLE_CHARS, []
    for r in rows.select("o", "n").orderBy("o", "n").limit(SAMPLE_PAGES).collect():
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["o"], r["n"]))
    if not chosen:
        return fit([])
    few = pages.sparkSession.createDataFrame(chosen, "o long, n int").distinct()
    return fit([r["html"] for r in rows.join(F.broadcast(few), ["o", "n"]).orderBy("o", "n").limit(SAMPLE_PAGES).select("html").collect()])


def extracted(pages: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns with text and n_chars of each page."""
    model = pages.sparkSession.sparkContext.broadcast(learned(pages))
    names = [f"c{i}" for i in range(len(columns))]
    rows = pages.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.coalesce("html", F.lit("")).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), model.value) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*names, "text", "n_chars"])

    return rows.mapInArrow(step, f"{kinds}{', ' if kinds else ''}text string, n_chars long").select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), "text", "n_chars")


@query("op8_maximum_scoring_subsequence")
def op8_maximum_scoring_subsequence(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, folder, "pages"), ["page_id", "url"])
