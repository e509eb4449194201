"""Language identification: known words first, then shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. An unseen
word is scored by its character n-grams of the longest length at which it has any known
ones, from ``MAX_GRAM`` letters (with word boundaries) down to one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import with_text_columns

MAX_GRAM = 5
#: Letters with their marks; digits, fractions and numerals in circles or of Rome's kind are none.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = re.compile(r"[a-z]+")
UNDETERMINED = "und"
#: Counts that are added to every frequency, and bounds of a worker's memory for words seen before.
SMOOTHING, CACHED, CACHED_CHARS = 0.5, 100_000, 40


#: Scores of words seen before that a worker keeps, over all languages.
CACHED_SCORES = 3_200_000
#: Up to so many scores a list is one array, which is read faster.
DENSE_SCORES = 4_000_000


class Scores:
    """Rows of log frequencies by language, of which only those above a language's ``least`` are stored."""

    def __init__(self, least: np.ndarray, offsets: np.ndarray, languages: np.ndarray, values: np.ndarray):
        self.least, self.offsets, self.languages, self.values = least, offsets, languages, values

    def __getitem__(self, rows) -> np.ndarray:
        at = np.atleast_1d(np.asarray(rows, dtype=np.int64))
        counts = self.offsets[at + 1] - self.offsets[at]
        out = np.repeat(self.least[None, :], len(at), axis=0)
        first = np.repeat(self.offsets[at] - (np.cumsum(counts) - counts), counts)
        entry = first + np.arange(len(first))
        out[np.repeat(np.arange(len(at)), counts), self.languages[entry]] = self.values[entry]
        return out if np.ndim(rows) else out[0]


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies: ``tables[0]`` of words, ``tables[n]`` of n-grams, each with a row of ``scores``."""

    languages: tuple[str, ...]
    prior: np.ndarray
    tables: tuple[dict[str, int], ...]
    scores: tuple[Scores | np.ndarray, ...]


def words_in(text: str) -> list[str]:
    """Words in lower case."""
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit_language(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    seed_cols: tuple[str, ...] = ("doc_id",),
    sample: int = 3000,
    sample_total: int = 20_000,
    min_count: int = 2,
    max_languages: int = 1000,
    seed: int = 1,
) -> LanguageModel:
    """Count words and n-grams in a bounded sample of labelled documents.

    About ``sample`` documents of each language, and ``sample_total`` of all, shared evenly, are drawn by a
    hash of ``seed_cols`` and the text; equal texts count once. The model keeps every word and
    n-gram that a language has ``min_count`` times in the sample, which thus bounds what reaches the driver and the
    tasks. More than ``max_languages`` languages are refused. Rows without a text
    or a language are not learned from; a table without any gives a model that answers
    ``und`` for everything.
    """
    rows = docs.select(*[col(c) for c in seed_cols], col(lang_col).cast("string").alias("__lang"), col(text_col).alias("__text"))
    rows = rows.where("__lang IS NOT NULL AND __text IS NOT NULL")
    totals = rows.groupBy("__lang").count().orderBy("__lang").limit(max_languages + 1).collect()
    if len(totals) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not totals:
        return LanguageModel((), np.zeros(0), tuple({} for _ in range(MAX_GRAM + 1)), ())
    names = [r["__lang"] for r in totals]
    n = np.array([r["count"] for r in totals], dtype=float)
    each = min(sample, sample_total / len(totals))
    shares = F.create_map(*[F.lit(x) for r in totals for x in (r["__lang"], min(1.0, each / r["count"]))])
    unit = F.pmod(F.xxhash64(F.lit(seed), *[col(c) for c in seed_cols], "__text"), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.where(unit < shares[F.col("__lang")]).select(F.col("__lang").alias("lang"), F.col("__text").alias("text")).distinct()
    counts = drawn.mapInArrow(count_grams, "lang string, size int, gram string, n long")
    counts = counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= min_count).toArrow()
    tables, scores = [], []
    for size in range(MAX_GRAM + 1):
        own = kept.filter(pc.equal(kept["size"], size))
        table = {g: i for i, g in enumerate(sorted(pc.unique(own["gram"]).to_pylist()))}
        row = np.fromiter((table[g] for g in own["gram"].to_pylist()), dtype=np.int64, count=len(own))
        language = pc.index_in(own["lang"], pa.array(names, own["lang"].type)).to_numpy().astype(np.int32)
        seen = own["n"].to_numpy() + SMOOTHING
        order = np.lexsort((language, row))
        row, language, seen = row[order], language[order], seen[order]
        total = np.bincount(language, weights=seen - SMOOTHING, minlength=len(names)) + SMOOTHING * len(table)
        least = np.log(SMOOTHING / np.maximum(total, SMOOTHING)).astype(np.float32)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(table)))]).astype(np.int64)
        tables.append(table)
        stored = Scores(least, offsets, language, np.log(seen / total[language]).astype(np.float32))
        scores.append(stored[np.arange(len(table))] if len(table) * len(names) <= DENSE_SCORES else stored)
    return LanguageModel(tuple(names), np.log(n / n.sum()), tuple(tables), tuple(scores))


def count_grams(batches):
    """Counts of words and n-grams by language, one row for each in a batch."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_in(text))
        for lang, counter in words.items():
            for size in range(MAX_GRAM + 1):
                found: Counter = Counter()
                for word, n in counter.items():
                    if size == 0:
                        found[word] = n
                    else:
                        for g in grams(word, size):
                            found[g] += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()),
                        pa.array([size] * len(found), pa.int32()),
                        pa.array(list(found), pa.string()),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    names=["lang", "size", "gram", "n"],
                )


class Reader:
    """Predicts texts. A task remembers the runs of text between blanks that it has seen.

    ``rows`` gives a run's row in ``matrix``: the sum of its words' scores by language, and
    how many words it has.
    """

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((0, len(self.model.languages) + 1), dtype=np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of each word: known ones first, then by shorter and shorter n-grams."""
        tables, scores = self.model.tables, self.model.scores
        out = np.zeros((len(words), len(self.model.languages)), dtype=np.float32)
        known = [(i, r) for i, w in enumerate(words) if (r := tables[0].get(w)) is not None]
        if known:
            at, rows = map(list, zip(*known, strict=True))
            out[at] = scores[0][rows]
        left = [i for i, w in enumerate(words) if w not in tables[0]]
        for size in range(MAX_GRAM, 0, -1):
            get, at, rows, counts, rest = tables[size].get, [], [], [], []
            for i in left:
                found = [r for g in grams(words[i], size) if (r := get(g)) is not None]
                if found:
                    at.append(i)
                    rows += found
                    counts.append(len(found))
                else:
                    rest.append(i)
            if at:
                starts = np.cumsum([0, *counts[:-1]])
                out[at] = np.add.reduceat(scores[size][rows], starts, axis=0) / np.array(counts, dtype=np.float32)[:, None]
            left = rest
        return out

    def learn(self, runs: list[str]) -> None:
        parts = [words_in(r) for r in runs]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        new = np.zeros((len(runs), self.matrix.shape[1]), dtype=np.float32)
        if place:
            flat = self.words(list(place))[[place[w] for p in parts for w in p]]
            (full,) = np.nonzero(counts)
            new[full, :-1] = np.add.reduceat(flat, (np.cumsum(counts) - counts)[full], axis=0)
            new[:, -1] = counts
        self.rows.update(zip(runs, range(len(self.matrix), len(self.matrix) + len(runs)), strict=True))
        self.matrix = np.concatenate([self.matrix, new])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model.languages
        if not languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        runs = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        distinct = set().union(*runs)
        new = distinct.difference(self.rows)
        if len(self.rows) + len(new) > min(CACHED, CACHED_SCORES // len(languages)):
            self.forget()
            new = distinct
        self.learn(list(new))
        answers = []
        for own in runs:
            at = np.fromiter(map(self.rows.__getitem__, own), dtype=np.int64, count=len(own))
            total = self.matrix[at].sum(axis=0, dtype=np.float64)
            if not total[-1]:
                answers.append((UNDETERMINED, 0.0))
                continue
            z = total[:-1] + self.model.prior
            best = int(z.argmax())
            answers.append((languages[best], float(1 / np.exp(z - z[best]).sum())))
        for run in [r for r in new if len(r) > CACHED_CHARS]:
            del self.rows[run]
        return answers


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred`` and its probability ``score`` for every row, from the whole text alone.

    ``und`` with score 0 for null texts, texts without a letter and an empty model. Ties go
    to the first language by name. Equal texts get equal answers. Kept columns with these
    names give way. The model has a bounded number of words and n-grams; it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        reader = Reader(shared.value)
        return lambda texts: list(zip(*reader.predict(texts), strict=True))

    return with_text_columns(docs, text_col, compute, "lang_pred string, score double", keep)
