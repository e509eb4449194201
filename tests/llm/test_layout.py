"""Mixing, packing and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from modelloom.llm.mixing import mix_sources, mixed_rows
from modelloom.llm.packing import best_filling, minimum_slack, pack_documents
from modelloom.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import edge_rows


def plain_targets(sizes: dict):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        rate = left / sum(weight[n] for n in free) if free else 0
        above = [n for n in free if weight[n] * rate > 3 * sizes[n]]
        if not above:
            return fixed | {n: weight[n] * rate for n in free}
        for n in above:
            fixed[n] = 3.0 * sizes[n]
            left -= fixed[n]


def check_mix(rows):
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len((r.text or "").encode().split())
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    targets = plain_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
    return targets, taken


def test_mix_of_documents(documents):
    mix = mix_sources(documents)
    rows = mix.collect()
    targets, taken = check_mix(rows)
    for name, target in targets.items():
        assert abs(taken[name] - target) <= 0.5 + 1e-6
    again = {(r.doc_id, r.taken) for r in mix_sources(documents.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    # Rows are taken by key: at most one of a source is taken in part.
    parts = Counter(r.source for r in rows if r["size"] and r.taken % r["size"])
    assert max(parts.values()) == 1


def test_mix_of_skewed_sources(spark):
    rows = [(i, "one two three " * (1 + i % 7), "big" if i % 3 else f"s{i % 40:02}") for i in range(600)]
    mix = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    targets, taken = check_mix(mix)
    for name, target in targets.items():
        assert abs(taken[name] - target) <= 0.5 + 1e-6


def test_mix_of_edge_rows(edge, no_docs):
    rows = mix_sources(edge).collect()
    assert len(rows) == len(edge_rows())
    check_mix(rows)
    assert mix_sources(no_docs).collect() == []
    only_empty = mix_sources(edge.where("doc_id IN (3, 4, 5)")).collect()
    assert {(r.taken, r.target) for r in only_empty} == {(0, 0.0)}


def test_mixed_rows(documents, edge):
    mix = mix_sources(documents)
    words = {r.doc_id: (r.taken, (r.text or "").encode().split()) for r in mix.collect()}
    rows = mixed_rows(mix, chars_col="n_chars")
    assert rows.columns == documents.columns
    got = defaultdict(list)
    for r in rows.collect():
        got[r.doc_id].append(r.text.encode().split())
    for key, (taken, own) in words.items():
        assert sum(map(len, got[key])) == taken
        for text in got[key]:
            assert text == own[: len(text)]
    assert mixed_rows(mix_sources(edge)).count() >= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(1, 60))
def test_filling_is_best(lengths, room):
    left = Counter(lengths)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    chosen = best_filling(left, room)
    assert sum(n * k for n, k in chosen.items()) == max(sums)
    assert all(left[n] >= k for n, k in chosen.items())


def test_windows_do_not_overlap():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 5000)
    window, offset = minimum_slack(lengths, 2048)
    used = Counter()
    for w, o, n in sorted(zip(window.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert o == used[w]
        used[w] += n
    assert max(used.values()) <= 2048
    assert len(used) <= 1.01 * int(lengths.sum()) / 2048 + 2
    assert [a.tolist() for a in minimum_slack(lengths[:0], 2048)] == [[], []]


def check_pack(docs, df):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for key, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            expected[key, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    rows = df.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return rows


def test_pack_of_documents(documents):
    rows = check_pack([(r.doc_id, r.text) for r in documents.collect()], pack_documents(documents, with_ids=True))
    for r in rows:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_pack_of_edge_rows(edge, no_docs):
    check_pack([(r[0], r[1]) for r in edge_rows()], pack_documents(edge))
    assert pack_documents(no_docs).collect() == []


def test_every_query_gives_rows(spark):
    for name, make in QUERIES.items():
        assert make(spark, DATA).count() > 0, name


def test_pipeline(spark, documents, tmp_path):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name in ("toxicity", "language", "near_duplicates"):
            assert docs.columns == documents.columns
            assert docs.join(before, documents.columns, "left_anti").count() == 0
            assert docs.count() > 0.7 * before.count()
    final = corpus_pipeline.run(spark, DATA)
    assert {tuple(r) for r in final.select("doc_id", "start", "ids_crc32").collect()} == {tuple(r) for r in docs.select("doc_id", "start", "ids_crc32").collect()}


def test_pipeline_of_edge_rows(spark, edge, no_docs):
    for start in (edge, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs.select([F.col(f"`{c}`") for c in docs.columns]), DATA)
        docs.collect()


def fuzzed_texts(rnd, n):
    marks = ["İ", "i̇", "Σ", ",", ".", "A", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "é", "e", "́", " ", "it's", "WE'LL", "'", "½"]
    letters = "aAbBcdeEßéÉİıŉſ .,,..\n\t\r'sS's<|>İ́̈ΣσςοΟKÅ\x01\x00ǅ日本🙂123½²①  "
    for i in range(n):
        yield [
            lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(30))),
            lambda: "".join(rnd.choice(marks) for _ in range(rnd.randrange(12))),
            lambda: "".join(chr(rnd.choice([rnd.randrange(32, 0x3000), rnd.randrange(0xE000, 0x20000)])) for _ in range(rnd.randrange(15))),
            lambda: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(9))) + rnd.choice(["", ".", ",", "..", ".,"]) for _ in range(6)).title(),
            lambda: "".join(chr(rnd.randrange(0xA0, 0x250)) if rnd.random() < 0.7 else rnd.choice(".,") for _ in range(rnd.randrange(15))),
        ][i % 5]()


def test_ids_of_fuzzed_texts_equal_the_library():
    import random

    from modelloom.llm.packing import TOKENIZER, TokenBytes, tokenizer_of

    path = public_tokenizers.path(TOKENIZER)
    texts = ["İ,", "İ.", "aİ,b", *fuzzed_texts(random.Random(5), 50_000)]
    found = TokenBytes(path).of(texts)
    wanted = tokenizer_of(path).encode_batch_fast(texts, add_special_tokens=False)
    for text, ids, own in zip(texts, found, wanted, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == own.ids, text


def test_remembered_runs_are_let_go(monkeypatch):
    from modelloom.llm import packing

    monkeypatch.setattr(packing, "CACHED", 5)
    path = public_tokenizers.path(packing.TOKENIZER)
    tokens = packing.TokenBytes(path)
    for i in range(20):
        text = f"word{i} other, again. {'long' * 20}"
        assert np.frombuffer(tokens.of([text])[0], dtype="<u4").tolist() == packing.tokenizer_of(path).encode(text, add_special_tokens=False).ids
        assert len(tokens) <= 5 + 8 and "long" * 20 not in tokens


def test_targets_of_sources_in_many_partitions(spark, monkeypatch):
    """Places of sources follow from one row per partition of their sort."""
    from modelloom.llm import mixing

    monkeypatch.setattr(mixing, "ROWS_EACH", 4)
    sizes = {**{f"s{i:02d}": 10 + i * i for i in range(40)}, None: 77}
    sources = spark.createDataFrame(list(sizes.items()), "name string, source_size long")
    found = {r.name: r.target for r in mixing.source_targets(sources, (5, 2, 1), 3).collect()}
    wanted = plain_targets(sizes)
    assert found.keys() == sizes.keys() and all(abs(found[n] - wanted[n]) < 1e-6 for n in sizes)


def test_stages_decide_as_plain_versions_do(spark, documents, labels):
    """Each stage on what the one before kept, against the definitions in the other tests."""
    from modelloom.llm.common import held_out
    from modelloom.llm.language import fit_language, predict_language
    from modelloom.llm.toxicity import fit_toxicity
    from tests.llm.test_models import plain_score
    from tests.llm.test_pairs import plain_components

    stages = dict(corpus_pipeline.STAGES)
    rows = documents.collect()
    model = fit_toxicity(documents, labels.where(~held_out(F.col("doc_id"))))
    clean = stages["toxicity"](spark, documents, DATA).persist()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in rows if plain_score(model, r.text) < 0.5)
    told = stages["language"](spark, clean, DATA).persist()
    # Single predictions are held against a plain scorer in test_models.
    sure = predict_language(clean, fit_language(clean.where(~held_out(F.col("doc_id"))))).collect()
    assert sorted(r.doc_id for r in told.collect()) == sorted(r.doc_id for r in sure if r.lang_pred != "und" and r.score >= 0.5)
    left = [(r.doc_id, r.text) for r in told.collect()]
    kept = stages["near_duplicates"](spark, told, DATA).persist()
    classes = plain_components(left, 5, 80)
    empty = {i for i, n, _ in classes if n == 0}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i if i in empty else least for i, _, least in classes})
    mixed = stages["mixing"](spark, kept, DATA).persist()
    sizes, taken = Counter(), Counter()
    for found, table in ((sizes, kept), (taken, mixed)):
        for r in table.collect():
            found[r.source] += len((r.text or "").encode().split())
    wanted = plain_targets(dict(sizes))
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
    check_pack([(r.doc_id, r.text) for r in mixed.collect()], stages["packing"](spark, mixed, DATA))
    for table in (clean, told, kept, mixed):
        table.unpersist()
