"""Keeping the main body of pages: maximum-scoring regions of lines.

Words score for the body or against it, and so do the marks of a page's structure: bullets, separators, list headings, and
how many pages of its site carry a line. The weights are log-odds fitted by logistic regression to labelled pages, the
``labelled_pages.txt`` beside this module, and then once more with a bounded sample of the pages at hand, on which site-wide
lines are labels too. A line scores the sum of its weights; one scan over the scores finds the regions no longer or shorter
region beats. Furniture also stands amid bodies, so a region ends where the score has dropped by more than ``DROP`` below
its best, and what follows may be a region of its own: doubtful lines between lines of the body stay, clear furniture
splits it, and scraps among furniture that don't reach ``LEAST`` go.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.session import fits_broadcast

#: A region ends where its score falls by more than this below its best; one of less than LEAST counts only if it is the
#: page's best. Both in log-odds.
DROP, LEAST = 1.0, 0.1
#: A line is a repeated one of a site if so large a share of the site's pages carry it, and at least so many pages.
SITE_SHARE, SITE_PAGES = 0.03, 3
#: A line that so many sites carry, each on such a share of its pages, says nothing about one of them, unless so high a share
#: of that one's pages carry it that it is furniture there.
COMMON_SITES, COMMON_SHARE, HIGH_SHARE = 3, 0.01, 0.25
#: The sample that weights are fitted to besides the labelled pages: pages, lines of them, and marks of a line, at most.
PAGES, LINES, MARKS = 4096, 40_000, 400
#: What a repeated line of a site costs at least, and one of a high share of its pages, where the sample has few of them.
SITE_COST = {"sign:site1": -4.0, "sign:site2": -8.0}
#: Bytes of site-wide lines up to which they are broadcast; measured before.
SITES_BYTES = 32 << 20
#: How many lines of the sample one labelled line outweighs, and the scores by the first weights that label a line of it.
WORTH, SURE_BODY, SURE_FURNITURE = 20.0, 1.0, -1.0
#: Log-odds of a line of unknown words, weight of body lines against furniture in all, and of the penalty on squared weights.
BIAS, PRIOR, RIDGE = 1.0, 1.0, 2e-5

_SPACE = re.compile(r"[ \r ​]+")
_BULLET = re.compile(r"^(?:[-*•»›·–▪]|\d+[.)])\s+")
_PARTS = re.compile(r"\s*[|·•\t]\s*|\s+[>›»/→—–]\s+|(?<=[.!?])\s+|(?<=[。！？])")
_TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,]*|[©@#%…»«→←↑▾]")
_WORD = re.compile(r"[^\W_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_END = re.compile(r"[.!?。！？]['\")”»]?$")


def tidy(line: str) -> str:
    """The line without outer white space, its inner white space (but tabs) as single spaces."""
    return _SPACE.sub(" ", line).strip()


def _tokens(text: str) -> list[str]:
    """Lower-case words, 0 for any number, some signs, and pairs of characters of scripts without spaces."""
    out = []
    for t in _TOKEN.findall(text.lower()):
        if "0" <= t[0] <= "9":
            out.append("0")
        elif t[0] < "⺀" or not _WIDE.match(t):
            out.append(t)
        else:
            out += [t[i : i + 2] for i in range(max(1, len(t) - 1))]
    return out


def marks(line: str, title: str = "") -> list[str]:
    """What a tidy line is judged by: its words and pairs of words, its short parts as wholes, and signs of structure."""
    bare = _BULLET.sub("", line)
    parts = [p for p in _PARTS.split(bare) if p]
    out = set()
    short = 0
    for part in parts:
        t = _tokens(part)
        out.update(t)
        if 0 < len(t) <= 8:
            out.update(map(" ".join, zip(t, t[1:])))
            out.update(("whole:" + " ".join(t), "first:" + t[0], "last:" + t[-1]))
            short += len(t) <= 3 and "0" not in t
    n = len(parts)
    if title and line == title:
        out.add("sign:title")
    if n >= 3 and short == n:
        out.add("sign:menu")
    if n >= 2 and sum(p[:1].isdigit() for p in parts) * 2 >= n:
        out.add("sign:table")
    if n >= 2 and title and tidy(parts[-1]) == title:
        out.add("sign:path")
    if "(c)" in line.lower()[:4] and "0" in out:
        out.add("©")
    if ":" in line[:-1] and "0" in out and n <= 2 and not _END.search(line):
        out.add("sign:value")
    return list(out)


class Weights:
    """Log-odds of marks for the body; ``score`` sums them up."""

    def __init__(self, bias: float, of: dict[str, float]):
        self.bias, self.of = bias, of

    def score(self, found: list[str]) -> float:
        get = self.of.get
        return self.bias + sum(get(m, 0.0) for m in found)


def fit(lines: list[list[str]], body: np.ndarray, weight: np.ndarray, rounds: int = 250, least: int = 1) -> Weights:
    """Logistic regression of ``body`` on the marks that at least ``least`` lines have, by accelerated descent. A line
    without known marks has the odds BIAS."""
    counts = Counter(m for found in lines for m in found)
    names = sorted(m for m, c in counts.items() if c >= least)
    number = {m: i for i, m in enumerate(names)}
    row = np.array([i for i, found in enumerate(lines) for m in found if m in number], dtype=np.int64)
    col = np.array([number[m] for found in lines for m in found if m in number], dtype=np.int64)
    sizes = np.maximum(np.bincount(row, minlength=len(lines)), 1)
    weight = weight * np.where(body, PRIOR / max((weight * body).sum(), 1e-9), 1 / max((weight * ~body).sum(), 1e-9))
    weight = weight / weight.sum()
    # A step that suits the steepest direction: marks by lines, weighted.
    step = 4.0 / max(float((weight * sizes).sum()), 1.0)
    w = ahead = np.zeros(len(names))
    for i in range(rounds):
        z = BIAS + np.bincount(row, ahead[col], minlength=len(lines))
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - body)
        new = ahead - step * (np.bincount(col, slope[row], minlength=len(names)) + RIDGE * ahead)
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return Weights(BIAS, {m: float(x) for m, x in zip(names, w) if abs(x) > 1e-3})


def labelled_pages(text: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(title, [(label, line)]) of pages in the form of ``labelled_pages.txt``: + body, - furniture, > furniture that heads
    a list of other pages."""
    pages: list[tuple[str, list[tuple[str, str]]]] = []
    for line in text.split("\n"):
        if line.startswith("== "):
            pages.append((line.split(" | ", 1)[1], []))
        elif line[:2] in ("+ ", "- ", "> "):
            pages[-1][1].append((line[0], line[2:]))
    return pages


@functools.cache
def _labelled() -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(marks, whether body, whether heading) of the labelled lines; entries of a list of other pages are left out, as its
    heading speaks for them."""
    found, label = [], []
    for title, lines in labelled_pages((Path(__file__).parent / "labelled_pages.txt").read_text(encoding="utf-8")):
        for i, (kind, line) in enumerate(lines):
            if kind != "-" or not _BULLET.match(line):
                own = marks(tidy(line), title)
                # The entries of a menu also stand in lines of their own.
                alone = [p for p in _PARTS.split(line) if p] if kind == "-" and "sign:menu" in own else []
                found += [own, *(marks(p, title) for p in alone)]
                label += [kind] * (1 + len(alone))
    label = np.array(label)
    return found, label == "+", label == ">"


@functools.cache
def first_weights() -> tuple[Weights, Weights]:
    """Weights from the labelled pages alone: of the body, and of list headings (below 0)."""
    found, body, head = _labelled()
    return fit(found, body, np.ones(len(body))), fit(found, ~head, np.ones(len(body)))


def sample_labels(text: str, title: str | None, site: dict[str, int], first: Weights, heads: Weights) -> Iterator[tuple[bool, list[str]]]:
    """(whether body, marks) of the lines of a page that can be told before the second fit.

    Site-wide lines are furniture, and lines that the first weights are sure of are what those say; the entries of lists of
    other pages are left out. Site-wide lines carry the sign of it, which so explains them: what is furniture on one site may
    be body on another.
    """
    lines = [tidy(x) for x in text.split("\n")]
    every = [marks(x, tidy(title or "")) if x else [] for x in lines]
    scores = [first.score(x) for x in every]
    entry = list_entries(lines, [s < 0 and heads.score(x) < 0 for s, x in zip(scores, every)])
    for line, found, score, listed in zip(lines, every, scores, entry):
        if listed or not 0 < len(found) <= MARKS:
            continue
        if line in site:
            yield False, [*found, f"sign:site{site[line]}"]
        elif score > SURE_BODY or score < SURE_FURNITURE:
            yield score > 0, found


def second_weights(sample: list[tuple[bool, list[str]]]) -> Weights:
    """Weights fitted to the labelled pages and to ``sample``, lines of the pages at hand."""
    found, body, _ = _labelled()
    label = np.concatenate([body, np.array([x for x, _ in sample], dtype=bool)])
    weight = np.concatenate([np.full(len(body), WORTH), np.ones(len(sample))])
    out = fit(found + [m for _, m in sample], label, weight, least=2)
    for mark, most in SITE_COST.items():
        out.of[mark] = min(out.of.get(mark, 0.0), most)
    return out


def list_entries(lines: list[str], heading: list[bool]) -> list[int]:
    """For each tidy line the number, from 1, of the heading whose list it is an entry of, else 0; ``heading`` tells the
    lines that can be one.

    Entries are lines with the same bullet, or, without bullets, lines that look like titles or teasers, up to the first
    that doesn't or is empty.
    """
    out, mark, head = [], None, 0
    for i, line in enumerate(lines):
        if not line:
            mark = mark if mark == "?" else None
            out.append(0)
            continue
        bullet = _BULLET.match(line)
        kind = bullet[0].strip()[-1] if bullet else ""
        if heading[i] and not _END.search(line):
            mark, head = "?", i + 1
        elif mark is not None:
            entry = (bool(bullet) and kind in "-*•»›·–▪") or (not bullet and (line.endswith("…") or (not _END.search(line) and line[-1:] not in ":：;" and len(_WORD.findall(line)) <= 12)))
            if entry and mark in ("?", kind):
                mark = kind
                out.append(head)
                continue
            mark = None
        out.append(0)
    return out


def line_scores(lines: list[str], title: str, site: dict[str, int], weights: Weights, heads: Weights) -> list[float]:
    """Scores of tidy lines: above 0 for the body, below for furniture, 0 for empty ones. The entries of a list of other
    pages cost what its heading costs."""
    scores, can_head = [], []
    for line in lines:
        found = marks(line, title) if line else []
        if line in site:
            found.append(f"sign:site{site[line]}")
        scores.append(weights.score(found) if line else 0.0)
        can_head.append(scores[-1] < 0 and heads.score(found) < 0)
    for i, head in enumerate(list_entries(lines, can_head)):
        if head:
            scores[i] = min(scores[i], scores[head - 1])
            continue
        # A list in one line, after its heading.
        first, colon, _ = lines[i].partition(":" if ":" in lines[i] else "：")
        if colon and len(first) <= 40:
            found = marks(first.strip(), title)
            if heads.score(found) < 0:
                scores[i] = min(scores[i], weights.score(found))
    return scores


def best_runs(scores: list[float], drop: float = DROP, least: float = LEAST) -> list[tuple[int, int]]:
    """The maximal-scoring regions [start, end), in one scan.

    A region opens at a line above 0, ends at its highest total, and is closed when the total has dropped by more than
    ``drop`` below that, or to 0; the scan goes on after its end. Regions of less than ``least`` are left out unless they are
    the best of the page.
    """
    runs: list[tuple[int, int, float]] = []
    i, n = 0, len(scores)
    while i < n:
        if scores[i] <= 0:
            i += 1
            continue
        start = end = i
        total = peak = 0.0
        while i < n:
            total += scores[i]
            i += 1
            if total >= peak and scores[i - 1] > 0:
                peak, end = total, i
            elif total <= 0 or peak - total > drop:
                break
        runs.append((start, end, peak))
        i = end
    best = max((p for _, _, p in runs), default=0.0)
    return [(a, b) for a, b, p in runs if p >= least or p == best]


def outside(text: str, title: str | None, site: dict[str, int], weights: Weights, heads: Weights) -> list[int]:
    """Numbers, from 0, of the lines outside the main body that hold more than white space."""
    lines = [tidy(x) for x in text.split("\n")]
    inside = [False] * len(lines)
    for a, b in best_runs(line_scores(lines, tidy(title or ""), site, weights, heads)):
        inside[a:b] = [True] * (b - a)
    return [i for i, x in enumerate(lines) if x and not inside[i]]


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of a page once."""
    for b in batches:
        sites, lines = [], []
        for site, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = {tidy(x) for x in text.split("\n")} - {""}
            sites += [site] * len(own)
            lines += own
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(lines, pa.string())], names=["site", "line"])


def site_lines(pages: DataFrame, keep: Callable[[DataFrame, str], DataFrame], share: float = SITE_SHARE, least: int = SITE_PAGES) -> DataFrame:
    """(site, lines): the lines that at least ``share`` of a site's pages carry, and at least ``least`` pages, as structs
    (line, level), level 2 from HIGH_SHARE on.

    Lines that COMMON_SITES sites or more carry on COMMON_SHARE of their pages are left out where fewer than HIGH_SHARE of the
    site's pages carry them: only shares tell, so that the same site comes out alike in a larger table. A page has so many
    lines on average, a site has at most 1 / share times as many here, whatever its size.
    """
    size = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    size = F.broadcast(size) if fits_broadcast(size, 64) else size
    counts = pages.select("site", "text").mapInArrow(_page_lines, "site string, line string").groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = keep(counts.join(size, "site").where(F.col("n") >= min(share, COMMON_SHARE) * F.col("pages")), "lines")
    often = counts.where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select("site", "line", F.when(F.col("n") >= HIGH_SHARE * F.col("pages"), 2).otherwise(1).alias("level"))
    common = counts.where(F.col("n") >= COMMON_SHARE * F.col("pages")).groupBy("line").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= COMMON_SITES)
    own = often.where("level = 2").unionByName(often.where("level = 1").join(common, "line", "left_anti").select("site", "line", "level"))
    return own.groupBy("site").agg(F.collect_list(F.struct("line", "level")).alias("lines"))


def _levels(lines: list[dict] | None) -> dict[str, int]:
    return {x["line"]: x["level"] for x in lines or ()}


def learned(rows: DataFrame) -> tuple[Weights, Weights]:
    """Weights for pages (id, title, text, lines), fitted to the labelled pages and to at most PAGES pages, LINES lines of
    them; the sample is drawn by hash of the id, so that it stays the same however the rows are spread."""
    first, heads = first_weights()
    n = rows.count()
    pick = F.pmod(F.xxhash64("id", "title"), F.lit(1 << 20)) < int(min(1.0, PAGES / max(n, 1)) * (1 << 20)) + 1
    shared = rows.sparkSession.sparkContext.broadcast((first, heads))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for title, text, lines in zip(*(b.column(i).to_pylist() for i in range(3))):
                out += [(good, "\x1f".join(sorted(m))) for good, m in sample_labels(text, title, _levels(lines), *shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.bool_()), pa.array([m for _, m in out], pa.string())], names=["body", "marks"])

    found = rows.where(pick).select("title", "text", "lines").mapInArrow(label, "body boolean, marks string")
    # In an order of their own, so that a cut at LINES takes the same lines every time.
    found = found.orderBy(F.xxhash64("marks"), "body").limit(LINES).toArrow()
    sample = [(x, m.split("\x1f")) for x, m in zip(found.column(0).to_pylist(), found.column(1).to_pylist())]
    return second_weights(sample), heads


def body_lines(passages: DataFrame, keep: Callable[[DataFrame, str], DataFrame], id_: str = "id", site: str = "sample", title: str = "title", text: str = "text") -> DataFrame:
    """(id, text, body, outside): each page's main body and the numbers of the non-empty lines outside it.

    Lines are split at every line feed and numbered from 0. Rows with one id count once (the smallest of differing
    texts), rows with a null id each on their own; a null text gives no row, an empty one an empty body. Pages without a
    site count as one site. Each page is scanned alone; across pages only counts of lines are gathered, and a sample for the
    weights.
    """
    rows = passages.where(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.coalesce(F.col(site), F.lit("")).alias("site"), F.col(title).alias("title"), F.col(text).alias("text"))
    one = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("text", "title", "site")).alias("r")).select("id", "r.site", "r.title", "r.text")
    pages = keep(one.unionByName(rows.where(F.col("id").isNull())), "pages")
    known = keep(site_lines(pages, keep), "sites")
    size = known.agg(F.coalesce(F.sum(F.aggregate("lines", F.lit(64).cast("long"), lambda a, x: a + 32 + 2 * F.length(x["line"]))), F.lit(0))).first()[0]
    known = F.broadcast(known) if size <= SITES_BYTES else known
    rows = pages.join(known, "site", "left").select("id", "title", "text", "lines")
    shared = rows.sparkSession.sparkContext.broadcast(learned(rows))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("body", T.StringType()), T.StructField("outside", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, bodies, out = [], [], [], []
            for id_, title, text, lines in zip(*(b.column(i).to_pylist() for i in range(4))):
                numbers = outside(text, title, _levels(lines), *shared.value)
                drop = set(numbers)
                ids.append(id_)
                texts.append(text)
                bodies.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop).strip())
                out.append(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(bodies, pa.string()), pa.array(out, pa.list_(pa.int32()))], names=["id", "text", "body", "outside"])

    return rows.mapInArrow(cut, schema)
