"""Language and toxicity models: held-out accuracy and edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from modelloom.llm.common import held_out
from modelloom.llm.language import LanguageModel, Reader, fit_language, predict_language
from modelloom.llm.toxicity import EVENTS, INSULT, NEGATION, PRIOR, REPORT, TARGET, THREAT, WORD, Scanner, base_model, compose, fit_toxicity, score_toxicity
from tests.llm.conftest import edge_rows


def test_language_of_held_out(documents):
    model = fit_language(documents.where(~held_out(F.col("doc_id"))))
    rows = predict_language(documents, model).where(held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_edge_rows(documents, edge, no_docs):
    model = fit_language(documents)
    rows = predict_language(edge, model).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
    assert predict_language(no_docs, model).collect() == []
    empty = fit_language(no_docs)
    assert {r.lang_pred for r in predict_language(edge, empty).collect()} == {"und"}
    assert fit_language(edge).languages == ("de", "en", "fr")


def test_known_words_come_first():
    model = fit_small()
    reader = Reader(model)
    assert (reader.words(["the"])[0] == model.scores[0][model.tables[0]["the"]]).all()
    # An unseen word falls back to n-grams that are known, the longest first.
    assert [a[0] for a in reader.predict(["thex", "12 34 !?", None, "xyz dex"])] == ["en", "und", "und", "de"]


def test_all_entries_of_many_languages_are_kept(spark, monkeypatch):
    from modelloom.llm import language

    monkeypatch.setattr(language, "DENSE_SCORES", -1)
    letters = "abcdefghijklmnopqrst"
    texts = [(i, " ".join(f"{a}{b}{c}" for b in letters for c in letters[:3]), f"l{a}") for i, a in enumerate(letters)]
    common = [(100 + i, f"{a}aa {a}bb " * 5, f"l{a}") for i, a in enumerate(letters)]
    df = spark.createDataFrame(texts + common, "doc_id long, text string, lang string")
    model = fit_language(df)
    assert len(model.languages) == 20
    # All words that a language has twice: the two common ones of each.
    assert set(model.tables[0]) == {f"{a}{x}" for a in letters for x in ("aa", "bb")}
    assert set(fit_language(df, min_count=1).tables[0]) == {w for _, t, _ in texts + common for w in t.split()}
    # Only what was seen is stored, and a row is whole again when it is read.
    row = model.scores[0][model.tables[0]["caa"]]
    assert len(row) == 20 and int(row.argmax()) == model.languages.index("lc")
    assert [r.lang_pred == r.lang for r in predict_language(df, model).collect()].count(False) == 0


def plain_prediction(counts, docs, text):
    """The language by the definition: words, then the longest n-grams of which any is known."""
    import math

    import regex

    def grams(word, n):
        padded = word if n == 1 else f" {word} "
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    words = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
    if not words:
        return "und", 0.0
    known = [set().union(*(counts[lang][n] for lang in counts)) for n in range(6)]
    z = {}
    for lang in counts:
        sizes = [sum(counts[lang][n].values()) + 0.5 * len(known[n]) for n in range(6)]
        z[lang] = math.log(docs[lang] / sum(docs.values()))
        for word in words:
            for n in (0, 5, 4, 3, 2, 1):
                found = [g for g in ([word] if n == 0 else grams(word, n)) if g in known[n]]
                if found:
                    z[lang] += sum(math.log((counts[lang][n].get(g, 0) + 0.5) / sizes[n]) for g in found) / len(found)
                    break
    best = max(sorted(z), key=z.get)
    return best, 1 / sum(math.exp(v - z[best]) for v in z.values())


def test_predictions_equal_plain_ones(documents, spark):
    from collections import Counter

    import regex

    train = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit_language(train)
    rows = train.collect()
    counts, docs = {}, Counter(r.lang for r in rows)
    for lang, text in {(r.lang, r.text) for r in rows}:
        own = counts.setdefault(lang, [Counter() for _ in range(6)])
        for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            own[0][word] += 1
            for n in range(1, 6):
                padded = word if n == 1 else f" {word} "
                own[n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
    counts = {lang: [Counter({g: n for g, n in c.items() if n >= 2}) for c in own] for lang, own in counts.items()}
    made = [(i, t) for i, t in enumerate(["½ ² ①", "Ⅷ", "\u0301", "नमस्ते", "xyzzy plugh", "the der le el", "a½b", ""])]
    texts = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    for r in predict_language(texts, model).collect():
        lang, score = plain_prediction(counts, docs, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3), r.text


def test_what_is_no_letter_is_undetermined(documents, spark):
    df = spark.createDataFrame([("½ ² ①",), ("Ⅷ 12",), ("\u0301",), ("½a",)], "text string")
    assert [r.lang_pred == "und" for r in predict_language(df, fit_language(documents)).collect()] == [True, True, True, False]


def fit_small() -> LanguageModel:
    import numpy as np

    tables = ({"the": 0, "der": 1}, {"t": 0, "d": 1}, {" t": 0, " d": 1}, {" th": 0, " de": 1}, {}, {})
    score = np.log(np.array([[0.1, 0.9], [0.9, 0.1]], dtype=np.float32))
    return LanguageModel(("de", "en"), np.zeros(2), tables, tuple(score if t else np.zeros((0, 2)) for t in tables))


@pytest.mark.parametrize(
    ("text", "event"),
    [
        ("what an idiot", (False, False, False, False)),
        ("you idiot", (False, True, False, False)),
        ("you are not an idiot", (False, True, True, False)),
        ("they said you idiot", (False, True, False, True)),
        ("i will kill you", (True, True, False, False)),
        ("i never kill you", (True, True, True, False)),
    ],
)
def test_events(text, event):
    counts = Scanner(base_model()).counts(text)
    assert {EVENTS[i] for i in counts.nonzero()[0]} == {event}


def test_clauses_are_apart():
    scanner = Scanner(base_model())
    assert scanner.counts("kill time. You may rest") .sum() == 0
    assert scanner.counts("never. An idiot").nonzero()[0].tolist() == [EVENTS.index((False, False, False, False))]
    assert scanner.counts("nothing of the kind") is None
    table = compose()
    assert all(0 <= after < len(table) for row in table for after, _ in row)


def test_toxicity_of_held_out_labels(spark):
    """Labels that the fit has not seen: nearly all are found, in every language, and clean texts are left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score_toxicity(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert all(r.predicted == int(r.score >= 0.5) for r in scored)
    toxic, clean = ([r.score for r in scored if r.toxic == want] for want in (1, 0))
    assert len(toxic) > 80 and len(clean) > 600
    area = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert area >= 0.95
    assert sum(s >= 0.5 for s in toxic) >= 0.9 * len(toxic) and sum(s >= 0.5 for s in clean) <= 0.003 * len(clean)


def plain_score(model, text):
    """The score by looking back from each core, without transducers."""
    import math
    import re

    kinds = dict.fromkeys(EVENTS, 0)
    cores = {}
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = WORD.findall(clause)
        signs = [model.symbols.get(w) for w in words]
        for i, word in enumerate(words):
            near = signs[max(0, i - 4) : i]
            negated, reported = NEGATION in near, REPORT in signs[:i]
            strength = 0.0
            if signs[i] is None:
                names = [word, *(word[:n] + "*" for n in (5, 4, 3, 2) if len(word) > n)]
                strength = next((model.learned[n] for n in names if n in model.learned), 0.0)
            if strength:
                left = (0.25 if negated else 1) * (0.5 if reported else 1)
                cores[word] = max(cores.get(word, 0), strength * left)
            elif signs[i] == INSULT:
                kinds[False, TARGET in near, negated, reported] += 1
            elif signs[i] == TARGET and THREAT in near:
                kinds[True, True, negated, reported] += 1
    best = sorted([0.0, 0.0, *cores.values()], reverse=True)[:2]
    z = model.weights[0] + sum(w * math.log2(1 + n) for w, n in zip(model.weights[1:17], kinds.values(), strict=True))
    return 1 / (1 + math.exp(-(z + model.weights[17] * best[0] + model.weights[18] * best[1])))


def test_scores_equal_plain_ones(documents, labels, spark):
    import random

    model = fit_toxicity(documents, labels, evidence=4.0, least_strength=0.5)
    rnd = random.Random(3)
    words = [*model.symbols, *model.learned, "word", "other", "thing", ".", "!", ":", "\n"]
    made = [(i, " ".join(rnd.choice(words).rstrip("*") for _ in range(rnd.randrange(30)))) for i in range(400)]
    texts = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    for r in score_toxicity(texts, model).collect():
        assert r.score == pytest.approx(plain_score(model, r.text), abs=1e-9)


def test_toxicity_of_edge_rows(edge, no_docs, labels):
    rows = score_toxicity(edge, base_model()).collect()
    assert len(rows) == len(edge_rows())
    assert {r.predicted for r in rows} == {0}
    assert score_toxicity(no_docs, base_model()).collect() == []
    # Without documents or labels of both kinds the grammar's own weights stay.
    assert fit_toxicity(no_docs, labels).weights == tuple(PRIOR)
    assert fit_toxicity(edge, labels.limit(0)).weights == tuple(PRIOR)


def test_new_insults_are_learned(spark):
    import random

    random.seed(1)
    plain = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in "mnrstvxzpq"]
    rows, marks = [], []
    for i in range(400):
        words = random.choices(plain, k=60)
        if i % 4 == 0:
            words[random.randrange(60)] = "grobnik"
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert model.learned["grobnik"] > 2
    assert Scanner(model).score(Scanner(model).counts("such a grobnik")) > 0.5


def test_scores_do_not_shift_with_the_sample(spark):
    # 2,000 clean documents and 250 toxic ones; a twentieth and a half of them have an insult.
    rows = [(i, f"word{i} is " + ("an idiot" if (i % 20 == 0 if i < 2000 else i % 2) else "here"), int(i >= 2000)) for i in range(2250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = []
    for sample in (200, 4000):
        scanner = Scanner(fit_toxicity(docs, docs, sample=sample, evidence=1e9))
        scores.append([scanner.score(scanner.counts(t)) for t in ("nothing here", "an idiot")])
    assert scores[0] == pytest.approx(scores[1], abs=0.1)
    assert scores[0][0] < 0.15
