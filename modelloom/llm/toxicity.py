"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols (insult, threat, target, negation, reported speech, other). One
small transducer follows each of these notions along a clause; composed, they read one
table entry per word and emit an event whenever an insult, or a threat against someone,
is complete: which core it was, whether it was aimed at someone, negated, or reported
from someone else. Events of the same kind share a weight. A document's score is the
logistic function of the weighted events in all of its clauses.

Weights start from the grammar's own and move towards labelled documents (a Gaussian
prior around the former). Labels also extend the cores by words, and by word beginnings of two
to five letters, that toxic documents use and clean ones hardly ever, as far as a likelihood ratio test
says so. Such a core has a strength of its own, the shrunk log-odds; a document counts its
two strongest ones, lessened where they are negated or reported: long clean texts hold one by chance.

The weights of built-in events that are negated or reported move with the labels as well; as far as
labelled documents hold no such case, they stay those of the grammar.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import mixed, shingles, with_text_columns, word_hashes, words_of

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Word lists of the grammar: fixed values.
WORDS = {
    INSULT: "idiot idiots idiotic moron morons moronic stupid loser losers pathetic worthless scum trash clown clowns "
    "disgusting imbecile imbeciles dumb dumbass fool fools foolish jerk jerks creep creeps freak freaks vermin filth filthy "
    "garbage bastard bastards bitch asshole assholes retard retarded dimwit halfwit coward parasite parasites subhuman "
    "idiota estúpido estúpida imbécil basura idiote imbécile connard salaud ordure dummkopf trottel arschloch abschaum",
    THREAT: "kill murder hurt beat punch stab shoot destroy strangle burn hang crush matar töten umbringen tuer frapper",
    TARGET: "you your yours yourself u he him his she her they them their those these du dich euch tu toi vous te ustedes",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't didn't can't won't nicht kein keine nunca jamás pas",
    REPORT: "said says say told tells called calls claimed claims wrote writes according alleged reported quote quoted dijo sagte disait",
}
#: How many words a target or a negation reaches, and how far a threat may be from its target.
REACH = {TARGET: 4, NEGATION: 4, THREAT: 4}
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: An event: (threat or insult, aimed at someone, negated, reported).
EVENTS = list(product((False, True), repeat=4))
BASE_WEIGHT = -3.0


def prior_weight(threat: bool, aimed: bool, negated: bool, reported: bool) -> float:
    return (5.0 if threat else 5.0 + 1.0 * aimed) * (0.25 if negated else 1.0) * (0.5 if reported else 1.0)


#: Weights of the constant, of each kind of event, and of the two strongest learned cores.
PRIOR = np.array([BASE_WEIGHT, *(prior_weight(*e) for e in EVENTS), 0.5, 0.5])
#: What is left of a learned core's strength in each kind of event.
LEFT = [prior_weight(*e) / prior_weight(e[0], e[1], False, False) for e in EVENTS]
#: Letters of word beginnings that can be learned; they are written with a star.
STEMS = (5, 4, 3, 2)
#: Words that a worker remembers.
CACHED = 200_000


def countdown(symbol: int, reach: int):
    """Transducer that holds for ``reach`` words after ``symbol``."""
    return lambda state, read: reach if read == symbol else max(0, state - 1)


TRANSDUCERS = (
    countdown(TARGET, REACH[TARGET]),
    countdown(NEGATION, REACH[NEGATION]),
    lambda state, read: 1 if read == REPORT else state,  # to the end of the clause
    countdown(THREAT, REACH[THREAT]),
)


def compose() -> list[list[tuple[int, int]]]:
    """The product of all transducers: for each state and symbol the next state and the event, -1 for none.

    States are numbered as they are reached from the start, which is 0.
    """
    numbers = {(0, 0, 0, 0): 0}
    queue, table = [(0, 0, 0, 0)], []
    for state in queue:
        row = []
        for symbol in range(6):
            after = tuple(step(s, symbol) for step, s in zip(TRANSDUCERS, state, strict=True))
            if after not in numbers:
                numbers[after] = len(numbers)
                queue.append(after)
            event = -1
            if symbol == INSULT:
                event = EVENTS.index((False, state[0] > 0, state[1] > 0, state[2] > 0))
            elif symbol == TARGET and state[3] > 0:
                event = EVENTS.index((True, True, state[1] > 0, state[2] > 0))
            row.append((numbers[after], event))
        table.append(row)
    return table


@dataclass(frozen=True)
class ToxicityModel:
    """Symbols of words, a weight for the constant, each kind of event and learned cores, and the cores' strengths."""

    symbols: dict[str, int]
    weights: tuple[float, ...]
    learned: dict[str, float] = field(default_factory=dict)


def base_model() -> ToxicityModel:
    return ToxicityModel({word: symbol for symbol, words in WORDS.items() for word in words.split()}, tuple(PRIOR))


class Lexicon(dict):
    """From a word to its symbol and, for a learned core, its strength: that of the word or else of its longest learned beginning."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.symbols, self.learned = model.symbols, model.learned

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > CACHED:
            self.clear()
        symbol = self.symbols.get(word)
        if symbol is not None:
            found = symbol, 0.0
        else:
            strength = next((self.learned[s] for s in spellings(word) if s in self.learned), 0.0)
            found = (INSULT if strength > 0 else OTHER), strength
        self[word] = found
        return found


def spellings(word: str) -> list[str]:
    """The word and its beginnings, the longest first."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Scanner:
    """Counts the events of texts, and finds their strongest learned core."""

    def __init__(self, model: ToxicityModel):
        self.lexicon, self.weights, self.table = Lexicon(model), model.weights, compose()

    def counts(self, text: str | None) -> np.ndarray | None:
        """Events by kind and the two strongest cores' strengths; None (the usual case) without a word that could be a core."""
        if not text:
            return None
        lowered, lexicon = text.lower(), self.lexicon
        if not any(lexicon[w][0] in (INSULT, THREAT) for w in set(WORD.findall(lowered))):
            return None
        found, table, cores = np.zeros(len(EVENTS)), self.table, {}
        for clause in CLAUSE.split(lowered):
            state = 0
            for word in WORD.findall(clause):
                symbol, strength = lexicon[word]
                state, event = table[state][symbol]
                if event < 0:
                    continue
                if strength:
                    cores[word] = max(cores.get(word, 0.0), strength * LEFT[event])
                else:
                    found[event] += 1
        return np.array([*found, *sorted([0.0, 0.0, *cores.values()])[:-3:-1]])

    def score(self, counts: np.ndarray | None) -> float:
        z = self.weights[0] if counts is None else float(features(counts) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(counts: np.ndarray) -> np.ndarray:
    return np.array([1.0, *np.log2(1 + counts[:-2]), *counts[-2:]])


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, sample: int, seed: int) -> tuple[DataFrame, dict[int, float]]:
    """About ``sample`` labelled ids of each label at most, drawn by a hash of the id, with one label each.

    Also how many ids of each label a drawn one stands for.
    """
    one = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    one = one.groupBy("id").agg(F.max("label").alias("label"))
    counts = dict(one.groupBy("label").count().collect())
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, sample / n)).otherwise(share)
    drawn = one.where((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / (1 << 30)) < share)
    return drawn, {label: counts[label] / n for label, n in drawn.groupBy("label").count().collect()}


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 4000,
    evidence: float = 18.0,
    least_strength: float = 2.0,
    prior_sd: float = 3.0,
    seed: int = 1,
) -> ToxicityModel:
    """Learn cores and weights from labelled documents.

    At most about ``sample`` documents of each label are used, whatever the tables hold; their ids are the only
    broadcast, and near copies among them count once. In the fit each stands for as many
    labelled ids as make the labels keep their rates. A word or beginning is learned if the
    likelihood ratio of its documents by label is at least ``evidence`` and its log-odds, with half a document added
    to each count, at least ``least_strength``; how many are is up to the sample. Strengths for
    the fit of the weights come from the other half of the documents, so that
    learning by heart does not count. Without labels of both kinds the grammar's own weights stay. Ids
    with several labels count as toxic if one says so; null ids and labels are left out.
    """
    drawn, stands_for = sampled_labels(labels, id_col, label_col, sample, seed)
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text IS NOT NULL")
    # Bounded by the sample size, about 2 * sample rows.
    texts = texts.join(F.broadcast(drawn), "id").select("text", "label")
    texts = with_text_columns(texts, "text", lambda: sketches, "m1 long, m2 long")
    texts = texts.groupBy("label", "m1").agg(F.min(F.struct("text", "m2")).alias("x")).select("label", "x.text", "x.m2")
    texts = texts.groupBy("label", "m2").agg(F.min("text").alias("text"))
    texts = texts.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")).persist()
    totals = {(r.label, r.half): r["count"] for r in texts.groupBy("label", "half").count().collect()}
    size = [sum(n for (label, _), n in totals.items() if label == want) for want in (0, 1)]
    if not all(size):
        texts.unpersist()
        return base_model()
    base = base_model()
    known = frozenset(base.symbols)
    uses = texts.mapInArrow(lambda batches: word_uses(batches, known), "label int, half int, symbol string, n long")
    counted = [F.sum(F.when((F.col("label") == label) & (F.col("half") == half), F.col("n")).otherwise(0)).alias(f"n{label}{half}") for label in (0, 1) for half in (0, 1)]
    uses = uses.groupBy("symbol").agg(*counted)
    kinds = {"whole": (0, 1), "by0": (0,), "by1": (1,)}
    strengths = [
        strength([sum((F.col(f"n{label}{h}") for h in halves), F.lit(0)) for label in (0, 1)], [sum(totals.get((label, h), 0) for h in halves) for label in (0, 1)], evidence, least_strength).alias(name)
        for name, halves in kinds.items()
    ]
    found = uses.select("symbol", *strengths).where("coalesce(whole, by0, by1) IS NOT NULL").collect()
    learned = {name: {r["symbol"]: r[name] for r in found if r[name] is not None} for name in kinds}
    # Each half is read with what the other one taught.
    models = [ToxicityModel(base.symbols, base.weights, learned[name]) for name in ("by1", "by0")]
    rows = []
    for half, model in enumerate(models):
        own = texts.where(F.col("half") == half)
        events = with_text_columns(own, "text", lambda model=model: lambda batch: [event_rows(Scanner(model), batch)], "counts array<double>", keep=["label"])
        rows += events.groupBy("label", "counts").count().collect()
    texts.unpersist()
    x = np.array([features(np.array(r.counts)) for r in rows])
    rates = [stands_for[label] * drawn_size / size[label] for label, drawn_size in enumerate(sampled_sizes(drawn))]
    n = np.array([r["count"] * rates[r.label] for r in rows])
    weights = fitted(x, np.array([float(r.label) for r in rows]), n, prior_sd)
    return ToxicityModel(base.symbols, tuple(weights), learned["whole"])


def sampled_sizes(drawn: DataFrame) -> list[int]:
    sizes = dict(drawn.groupBy("label").count().collect())
    return [sizes.get(label, 0) for label in (0, 1)]


def strength(counts: list[Column], totals: list[int], evidence: float, least: float) -> Column:
    """Log-odds of a symbol's clean and toxic documents where they are high enough and tell more than chance, else null."""
    (clean, toxic), (all_clean, all_toxic) = counts, totals
    if not all_clean or not all_toxic:
        return F.lit(None).cast("double")
    odds = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1))
    share = all_toxic / (all_clean + all_toxic)
    ratio = F.lit(0.0)
    for n, expected in ((toxic, (clean + toxic) * share), (clean, (clean + toxic) * (1 - share))):
        ratio = ratio + F.when(n > 0, 2 * n * F.log(n / F.nullif(expected, F.lit(0.0)))).otherwise(0.0)
    return F.when((ratio >= evidence) & (odds >= least), odds)


def event_rows(scanner: Scanner, texts: list) -> list[list[float]]:
    none = [0.0] * (len(EVENTS) + 2)
    return [none if c is None else c.tolist() for c in map(scanner.counts, texts)]


def sketches(texts: list[str]) -> list[list[int]]:
    """Two sketches of each text, of two least hashes of its windows of five words each: near copies share one as a rule."""
    found: list[list[int]] = [[], []]
    for text in texts:
        hashes = shingles(word_hashes(words_of(text)), 5)
        for i, out in enumerate(found):
            least = [int(mixed(hashes + np.uint64(2 * i + j)).min()) if len(hashes) else 0 for j in range(2)]
            out.append(hash(tuple(least)))
    return found


def word_uses(batches, known: frozenset[str]):
    """In how many documents of each label and half a word or beginning stands; words of the grammar are left out."""
    for batch in batches:
        found: Counter = Counter()
        for text, label, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = set(WORD.findall(text.lower())) - known
            found.update((label, half, s) for s in {s for w in words for s in spellings(w)})
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.string())
        arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["label", "half", "symbol", "n"])


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior_sd: float) -> np.ndarray:
    """Logistic weights with a Gaussian prior around the grammar's, by Newton's method with halved steps."""
    w, inverse = PRIOR.copy(), np.diag([1e-4, *[prior_sd**-2] * (len(EVENTS) + 2)])

    def loss(w):
        z = x @ w
        return n @ (np.logaddexp(0, z) - y * z) + 0.5 * (w - PRIOR) @ inverse @ (w - PRIOR)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + inverse @ (w - PRIOR)
        step = np.linalg.solve((x.T * (n * p * (1 - p) + 1e-9)) @ x + inverse, gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``n_events`` for every row (of learned cores two count).

    Whole texts are read; null and empty texts have no event and get the score of a text
    without any. Equal rows get equal scores. Kept columns with these names give way. The
    model is a word list of bounded size that goes along with the tasks.
    """

    def compute():
        scanner = Scanner(model)

        def score(texts):
            counts = [scanner.counts(t) for t in texts]
            scores = [scanner.score(c) for c in counts]
            return scores, [int(s >= threshold) for s in scores], [0 if c is None else int(c[:-2].sum() + (c[-2:] > 0).sum()) for c in counts]

        return score

    return with_text_columns(docs, text_col, compute, "score double, predicted int, n_events int", keep)
