"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes good, votes bad or abstains. How often each
rule is right about good and about bad texts, and how many texts are good, is estimated
from the votes alone by expectation-maximisation over the distinct patterns of votes, of
which there are at most three to the number of rules, whatever the table. A text is kept if
its posterior probability of being good reaches one half.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelloom.llm.common import checkpointed, word_hashes, words_of, with_text_columns

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("__lines", "__upper", "__letters", "__ended_lines", "__distinct_words", "__shouts", "__wide", "__bare_words")
#: Where the estimates start: the share of good votes on good and on bad texts (most bad
#: texts break few rules), and the share of good texts.
GOOD, BAD, SHARE = 0.98, 0.6, 0.85
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """Votes good below (or from) one bound, bad beyond the other, and abstains in between."""

    name: str
    value: Callable[[], Column]
    good: float
    bad: float

    def vote(self) -> Column:
        """1 for good, -1 for bad, 0 for abstaining; texts without words get no vote."""
        v = self.value()
        low_is_good = self.good < self.bad
        good, bad = (v <= self.good, v >= self.bad) if low_is_good else (v >= self.good, v <= self.bad)
        return F.coalesce(F.when(good, 1).when(bad, -1), F.lit(0)).cast("int")


def ratio(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(b) > 0, F.col(a) / F.col(b))


RULES = (
    Rule("short_words", ratio("word_chars", "n_words"), 9, 13),
    Rule("long_words", ratio("word_chars", "n_words"), 3.2, 2.2),
    Rule("few_symbols", ratio("n_symbols", "n_words"), 0.05, 0.3),
    Rule("plain_chars", lambda: F.when(F.col("word_chars") > 0, (F.col("__letters") + F.col("__wide")) / F.col("word_chars")), 0.93, 0.86),
    Rule("few_bare_words", ratio("__bare_words", "n_words"), 0.05, 0.3),
    Rule("few_dup_lines", ratio("n_dup_lines", "__lines"), 0.05, 0.3),
    Rule("few_repeats", ratio("n_repeat_words", "n_words"), 0.15, 0.35),
    Rule("distinct_words", ratio("__distinct_words", "n_words"), 0.3, 0.12),
    Rule("few_capitals", ratio("__upper", "__letters"), 0.15, 0.5),
    Rule("few_shouts", ratio("__shouts", "n_words"), 0.02, 0.3),
    Rule("ended_lines", ratio("__ended_lines", "__lines"), 0.6, 0.1),
    Rule("long_enough", lambda: F.col("n_words"), 80, 49),
)


def text_counts(text: str | None) -> tuple[int, ...]:
    """``BASE`` and ``MORE`` of a whole text; all 0 for null and empty ones."""
    if not text:
        return (0,) * (len(BASE) + len(MORE))
    data = text.encode()
    words = words_of(text)
    n = len(words)
    blanks = sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    word_chars = len(text) - blanks
    n_symbols = sum(data.count(s) for s in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.split()]
    ids = word_hashes(words)
    upper = len(data) - len(data.translate(None, UPPER))
    letters = upper + len(data) - len(data.translate(None, LOWER))
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for line in lines)
    return (
        n,
        word_chars,
        n_symbols,
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        upper,
        letters,
        ended,
        len(set(words)),
        data.count(b"!!"),
        sum(c > "\x7f" for c in text) if not text.isascii() else 0,
        sum(not LETTER.search(w) for w in words),
    )


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words which the text has at least twice."""
    if len(ids) < 4:
        return 0
    _, number = np.unique(ids, return_inverse=True)
    number = number.astype(np.int64)
    pairs = number[:-1] * len(ids) + number[1:]
    _, pair = np.unique(pairs, return_inverse=True)
    _, window, many = np.unique(pair[:-1] * len(ids) + number[2:], return_inverse=True, return_counts=True)
    twice = many[window] > 1
    marked = np.zeros(len(ids), dtype=bool)
    for i in range(3):
        marked[i : i + len(twice)] |= twice
    return int(marked.sum())


@dataclass(frozen=True)
class VoteModel:
    """The logarithm of the odds of good texts, and what each rule's vote adds to it."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        total = F.lit(self.prior)
        for vote, good, bad in zip(votes, self.good, self.bad, strict=True):
            total = total + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
        return total


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
    """Accuracies by expectation-maximisation over distinct patterns of votes and how often each occurs.

    Rules start, and are softly held by pseudo-counts, on the side of being right more often
    than not, so that good and bad can't change places. Without any vote the prior decides.
    """
    counts = counts.astype(float)
    m = votes.shape[1]
    weight = 0.02 * counts.sum() + 1
    # Share of good votes among a rule's votes on good and on bad texts.
    on_good, on_bad, share = np.full(m, GOOD), np.full(m, BAD), SHARE
    for _ in range(rounds):
        z = np.log(share / (1 - share)) + ((votes == 1) @ np.log(on_good / on_bad) + (votes == -1) @ np.log((1 - on_good) / (1 - on_bad)))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        before = np.r_[on_good, on_bad, share]
        good, bad = counts * p, counts * (1 - p)
        on_good = (good @ (votes == 1) + GOOD * weight) / (good @ (votes != 0) + weight)
        on_bad = (bad @ (votes == 1) + BAD * weight) / (bad @ (votes != 0) + weight)
        share = (good.sum() + SHARE * weight) / (counts.sum() + weight)
        if np.abs(np.r_[on_good, on_bad, share] - before).max() < 1e-9:
            break
    return VoteModel(float(np.log(share / (1 - share))), tuple(np.log(on_good / on_bad).tolist()), tuple(np.log((1 - on_good) / (1 - on_bad)).tolist()))


def judge_quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """``n_words``, the four counts, ``base_failed``, ``quality`` and ``kept`` of every row.

    ``quality`` is the posterior probability of being good; ``kept`` rows reach ``least`` and
    don't fail the base rules (fewer than 50 words, or more than half of the words repeated in
    windows of three). Whole texts are read. Null and empty texts have no words, so they fail.
    Equal rows get equal answers and count as many as they are. Kept columns with the added
    names give way. An empty table gives no rows. Counts are made once and checkpointed.
    """
    added = [*BASE, *MORE]
    schema = ", ".join(f"{n} long" for n in added)
    counted = with_text_columns(docs, text_col, lambda: lambda texts: list(zip(*map(text_counts, texts), strict=True)), schema, keep)
    names = [f"__vote_{r.name}" for r in rules]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = counted.withColumns({n: r.vote() for n, r in zip(names, rules, strict=True)}).withColumn("base_failed", failed)
    voted = checkpointed(voted)
    # Estimated where the verdict counts. At most three to the number of rules.
    patterns = voted.where("NOT base_failed").groupBy(*names).count().collect()
    model = fit_votes(np.array([r[:-1] for r in patterns]).reshape(-1, len(rules)), np.array([r[-1] for r in patterns]))
    judged = voted.withColumn("quality", 1 / (1 + F.exp(-model.log_odds([F.col(n) for n in names]))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop(*names, *MORE)
