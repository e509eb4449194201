"""Token counts, fingerprints and quality counts against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modelloom.llm.fingerprints import Fingerprints, edited, fingerprint_documents, fingerprint_with_next
from modelloom.llm.quality import RULES, fit_votes, judge_quality, repeated_words, text_counts
from modelloom.llm.token_counts import MergeTable, TokenCounter, count_tokens
from tests.llm.conftest import edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_tokens_of_odd_texts(library):
    random.seed(5)
    letters = [*"aAbB zZ  \n\t\r'sdtlmrev0129.,!?-_ ", *"éßñ日本🙂٣Ⅷ²한́  \u0085\x1c\x0b‍﻿", "<|endoftext|>", "'ll", "ababab"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(5000)]
    texts += ["a" * 4001, "ab" * 900, "".join(random.choices("abcdefgh", k=3000)), None, ""]
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert TokenCounter(MergeTable(PATH)).count(texts) == expected


def test_count_tokens(edge, no_docs, library):
    rows = count_tokens(edge, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    assert count_tokens(no_docs).collect() == []
    assert "N_TOKENS" not in count_tokens(edge).columns


def shingle_set(text, size=5):
    words = text.encode().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_documents(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    found = {r.doc_id: r for r in fingerprint_with_next(documents).collect()}
    errors = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        changed = edited(text, after)
        r = found[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        errors += [r.near_edited - jaccard(shingle_set(text), shingle_set(changed)), r.near_next - jaccard(shingle_set(text), shingle_set(after))]
    assert np.sqrt(np.mean(np.square(errors))) < 0.03
    assert abs(np.mean(errors)) < 0.01
    alone = {r.doc_id: r.fingerprint for r in fingerprint_documents(documents, keep=["doc_id"]).collect()}
    assert alone == {k: r.fingerprint for k, r in found.items()}


def test_fingerprints_of_edge_rows(edge, no_docs, spark):
    rows = fingerprint_with_next(edge).collect()
    assert len(rows) == len(edge_rows())
    order = sorted(((k is not None, k or 0, t or "") for k, t, *_ in edge_rows()))
    following = Counter()
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        following[a[1] if a[0] else None, hashlib.sha256(edited(a[2], b[2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in rows) == following
    assert fingerprint_with_next(no_docs).collect() == []
    (one,) = fingerprint_with_next(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_packing_of_bits(bits):
    how = Fingerprints(bins=64, bits=bits)
    values = how.values("one two three four five six seven eight nine ten")
    assert len(how.packed(values)) == 64 * bits // 4
    assert (how.unpacked(how.packed(values)) == values).all()
    assert how.likeness(values, values) == 1.0
    assert how.likeness(None, values) == 0.0
    assert how.likeness(None, None) == 1.0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(marked)


def test_quality_counts(documents):
    for r in documents.select("text").collect():
        assert text_counts(r.text)[:5] == plain_counts(r.text)
    for text in ("", None, "a a a", "a b c a b c", "x\nx\n\n\nx \x0b y", "é é é é #<>"):
        assert text_counts(text)[:5] == plain_counts(text)
    assert repeated_words(np.zeros(5, dtype=np.uint64)) == 5


def test_quality_of_edge_rows(edge, no_docs):
    rows = judge_quality(edge).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        n, chars, symbols, doubled, repeated = plain_counts(r.text)
        failed = n < 50 or 100 * repeated > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, doubled, repeated, failed)
        assert not (r.kept and failed)
    assert judge_quality(no_docs).collect() == []


def test_quality_agrees_with_labels(documents, labels):
    found = judge_quality(documents, keep=["doc_id"]).where("NOT base_failed").select("doc_id", "kept")
    rows = found.join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95


def test_votes_find_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    votes = np.where(rng.random((20000, 6)) < np.where(good, 0.97, 0.35)[:, None], 1, -1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = fit_votes(patterns, counts)
    odds = model.prior + (votes == 1) @ np.array(model.good) + (votes == -1) @ np.array(model.bad)
    assert ((odds > 0) == good).mean() > 0.95
    assert len(RULES) == len({r.name for r in RULES})
