"""Rankers and embedders as protocols, run by Spark, with offline stand-ins for services."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.judging import parse_scores, scored_count, stated_scores, terms_of


@dataclass
class Answer:
    """What a ranker returns for one question: a score for each passage, or None for the given order."""

    scores: list[float] | None = None
    model: str = ""
    input_tokens: int = 0
    output_tokens: int = 0
    error: str | None = None
    raw: str | None = None
    covered: int | None = None


class Ranker(Protocol):
    id: str

    def rank(self, query: str, passages: list[str]) -> Answer: ...


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class GivenOrder:
    """The baseline: no scores, so the first stage's order stays."""

    id = "given-order"

    def rank(self, query: str, passages: list[str]) -> Answer:
        return Answer(model=self.id)


@dataclass
class TermOverlap:
    """An offline ranker: shares of the query's terms that a passage holds."""

    id: str = "term-overlap"

    def rank(self, query: str, passages: list[str]) -> Answer:
        wanted = {t for t, _ in terms_of(query)}
        scores = [len(wanted & {t for t, _ in terms_of(p)}) / max(1, len(wanted)) for p in passages]
        return Answer(scores, self.id, sum(map(len, passages)) // 4)


@dataclass
class Judge:
    """A ranker that asks a text model through ``ask`` (prompt -> answer, cut off?) and reads the scores leniently."""

    ask: Callable[[str], tuple[str, bool]]
    id: str = "judge"
    kept: int = 4000

    def rank(self, query: str, passages: list[str]) -> Answer:
        listed = "\n\n".join(f"[{i}] {p}" for i, p in enumerate(passages))
        text, cut = self.ask(f"Query: {query}\n\nSnippets:\n{listed}")
        scores = parse_scores(text, len(passages))
        if scores is None and not cut:
            scores = stated_scores(text, len(passages))
        error = None if scores else "no scores in the answer"
        return Answer(scores, self.id, raw=text[: self.kept], covered=scored_count(text, len(passages)), error=error)


@dataclass
class PerPair:
    """A ranker that scores one passage at a time, such as a cross-encoder or a classifier's probability."""

    score: Callable[[str, str], float]
    id: str = "per-pair"

    def rank(self, query: str, passages: list[str]) -> Answer:
        return Answer(dense_scores({i: self.score(query, p) for i, p in enumerate(passages)}, len(passages)), self.id)


def dense_scores(found: dict[int, float], n: int) -> list[float]:
    """Scores by index as a list; an unscored passage is an error."""
    if missing := [i for i in range(n) if i not in found]:
        raise ValueError(f"no score for passages {missing}")
    return [float(found[i]) for i in range(n)]


class HashedEmbedder:
    """An offline embedder: unit vectors of hashed terms."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for term, _ in terms_of(t):
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                out[i, h % self.width] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()


# Fixed value: seconds between two attempts at most.
LONGEST_PAUSE = 8.0


@dataclass
class Attempts:
    """Calls once more after a passing fault, up to ``most`` times, with exponential pauses and jitter.

    ``ms`` times the answering attempt, ``total_ms`` all of it, pauses included.
    """

    most: int = 4
    pause: Callable[[float], None] = time.sleep
    chance: random.Random = field(default_factory=lambda: random.Random(7))

    def pauses(self) -> Iterator[float]:
        """The seconds to wait before each further attempt: doubling up to a limit, of which half is left to chance."""
        longest = 1.0
        for _ in range(self.most - 1):
            yield longest * self.chance.uniform(0.5, 1.0)
            longest = min(LONGEST_PAUSE, 2 * longest)

    def __call__(self, once: Callable[[], Answer], passing: Callable[[str], bool]) -> tuple[Answer, int, float, float]:
        times = [time.perf_counter()]
        waits = self.pauses()
        attempts = 0
        while True:
            times.append(time.perf_counter())
            try:
                answer = once()
            except Exception as e:  # a service's fault is a result
                answer = Answer(error=str(e))
            times.append(time.perf_counter())
            attempts += 1
            wait = next(waits, None) if answer.error and passing(answer.error) else None
            if wait is None:
                return answer, attempts, (times[-1] - times[-2]) * 1000, (times[-1] - times[0]) * 1000
            self.pause(wait)


class Budget:
    """A sliding allowance of so many units in so many seconds; ``wait`` says how long to hold a request back."""

    def __init__(self, units: float, seconds: float = 60, clock: Callable[[], float] = time.monotonic):
        self.units, self.seconds, self.clock, self.spent = units, seconds, clock, []

    def wait(self, need: float) -> float:
        now = self.clock()
        self.spent = [(t, u) for t, u in self.spent if t > now - self.seconds]
        used, hold = sum(u for _, u in self.spent), 0.0
        for t, u in self.spent:
            if used + need <= self.units:
                break
            used -= u
            hold = t + self.seconds - now
        return hold

    def spend(self, units: float) -> None:
        self.spent.append((self.clock(), units))


def rank_all(candidates: DataFrame, ranker: Ranker, passing: Callable[[str], bool] = lambda e: False) -> DataFrame:
    """(question, scores, model, inputtokens, outputtokens, attempts, error, raw, covered, ms, totalms) of every question.

    ``candidates`` has (question, query, pos, text); a question's candidates, a list of bounded length, are one group.
    """

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        a, attempts, ms, total = Attempts()(lambda: ranker.rank(df["query"].iloc[0] or "", [t or "" for t in df["text"]]), passing)
        return pd.DataFrame([(df["question"].iloc[0], a.scores, a.model, a.input_tokens, a.output_tokens, attempts, a.error, a.raw, a.covered, ms, total)], columns=names)

    kind = candidates.schema["question"].dataType.simpleString()
    names = ["question", "scores", "model", "inputtokens", "outputtokens", "attempts", "error", "raw", "covered", "ms", "totalms"]
    schema = f"question {kind}, scores array<double>, model string, inputtokens long, outputtokens long, attempts int, error string, raw string, covered int, ms double, totalms double"
    return candidates.select("question", "query", "pos", "text").groupBy("question").applyInPandas(one, schema)


def embed_all(rows: DataFrame, key: str, text: str, embedder: Embedder, prompt: str = "", batch: int = 64) -> DataFrame:
    """(key, vec), embedded in batches; a vector of another width is an error. Null texts have no vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at in range(0, len(df), batch):
                part = df.iloc[at : at + batch]
                vecs = embedder.embed([prompt + t for t in part[text]])
                if any(len(v) != embedder.width for v in vecs):
                    raise ValueError("a vector has another width")
                yield pd.DataFrame({key: part[key], "vec": vecs})

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, vec array<float>")


def embed_within(embed: Callable[[list[str]], list[list[float]]], texts: list[str], too_long: Callable[[Exception], bool], cuts: int = 8, share: float = 0.75) -> list[list[float]]:
    """Vectors of texts of which some may exceed a service's limit.

    A batch that is refused as too long is split in halves; a single text is cut to its first 75 % of code points, and so on
    up to ``cuts`` times.
    """
    try:
        return embed(texts)
    except Exception as e:
        if not too_long(e) or not texts:
            raise
        if len(texts) > 1:
            half = len(texts) // 2
            return embed_within(embed, texts[:half], too_long, cuts, share) + embed_within(embed, texts[half:], too_long, cuts, share)
        if cuts == 0:
            raise
        return embed_within(embed, [texts[0][: int(len(texts[0]) * share)]], too_long, cuts - 1, share)
