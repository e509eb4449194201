"""Similarity join, components, chats and license scans against plain versions."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np
import pytest

from modelloom.llm import chat
from modelloom.llm.components import connected_components
from modelloom.llm.jaccard import Likeness, one_of_each, similar_documents
from modelloom.llm.licenses import TEMPLATES, Templates, scan_licenses, shingled, stretch
from tests.conftest import DATA
from tests.llm.conftest import edge_rows


def plain_components(rows, words, percent):
    """Component of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[top(j)] = top(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    least = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            least[i] = min(ids) if ids else None
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))]


def as_rows(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_join_of_documents(documents, words, percent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = similar_documents(documents, like=Likeness(words=words, percent=percent))
    assert as_rows(found) == sorted(plain_components(rows, words, percent), key=str)


def test_join_of_near_copies(spark):
    """A family of copies with more and more changed words, larger than one block."""
    random.seed(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1300):
        words = list(base)
        for at in random.sample(range(120), i % 9):
            words[at] = f"x{random.randrange(50)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(similar_documents(docs, like=Likeness(words=3, percent=90))) == sorted(plain_components(rows, 3, 90), key=str)


def test_join_of_edge_rows(edge, no_docs):
    rows = [(r[0], r[1]) for r in edge_rows()]
    found = similar_documents(edge, like=Likeness(words=3, percent=90))
    assert as_rows(found) == sorted(plain_components(rows, 3, 90), key=str)
    assert similar_documents(no_docs).collect() == []
    kept = one_of_each(edge, like=Likeness(words=3, percent=90))
    assert kept.columns == edge.columns
    # 1 stays for its group; id 2's other text, 6, 7 and 8 are alone; four texts have no shingle.
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(["1", "2", "6", "7", "8", "None", "3", "4", "5"])
    assert one_of_each(no_docs).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (201, 200), (5, 5), (None, 3)] + [(1000, i) for i in range(1001, 1100)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200, **{i: 1000 for i in range(1000, 1100)}}
    assert found == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_chats(rows):
    turns = {}
    for conv, turn, role, text in set(rows):
        turns.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    said = {c: tuple((r, t) for _, _, r, t in sorted(x)) for c, x in turns.items()}
    starts = {s[:n] for s in said.values() for n in range(1, len(s))}
    first = {}
    for c, s in said.items():
        first[s] = min((x for x in (c, first.get(s, c)) if x is not None), default=None)
    return sorted(((first[s], len(s), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s)) for s in first if s not in starts), key=str)


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"), (3, 2, "user", "bye"),
        (4, 0, "user", "hi"), (5, 0, "user", None), (5, 0, "system", "tie"), (6, None, None, None),
        (None, 0, "user", "no id"), (7, 5, "user", "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS PLACE", "2 AS rendered")
    found = sorted(((r.conv_id, r.n_turns, r.rendered) for r in chat.format_chats(df).collect()), key=str)
    assert found == plain_chats(rows)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chats_equal_sql(spark):
    df = chat.format_chats(spark.read.parquet(f"{DATA}/conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(chat.SQL).fetchall())


def plain_licenses(text):
    """Templates of which some stretch of the text holds the share asked for."""
    found, out = shingled(text), set()
    for name, template in TEMPLATES.items():
        own = np.unique(shingled(template))
        for start in range(len(found)):
            if found[start] in own and len(np.intersect1d(found[start : start + stretch(len(shingled(template)))], own)) >= 0.8 * len(own):
                out.add(name)
                break
    return out


def test_licenses_of_documents(documents, edge, no_docs):
    found = {}
    for r in scan_licenses(documents).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    for r in documents.collect():
        assert found.get(r.doc_id, set()) == plain_licenses(r.text)
    assert found
    assert scan_licenses(edge).collect() == []
    assert scan_licenses(no_docs).collect() == []


def test_licenses_with_changes():
    templates = Templates(tuple(TEMPLATES.items()))
    random.seed(4)
    for name, template in TEMPLATES.items():
        if len(template.split()) < 30:
            continue
        words = template.split()
        words[len(words) // 2] = "changed"
        filler = [f"f{i}" for i in range(random.randrange(500))]
        text = " ".join([*filler, *words, *filler, *words])
        hits = [m for m in templates.matches(text) if templates.texts[m[0]][0] == name]
        assert len(hits) == 2
        assert name in plain_licenses(text)


def test_short_templates_are_refused(no_docs):
    with pytest.raises(ValueError, match="need 5 words"):
        scan_licenses(no_docs, templates={"x": "too short"})


def test_a_long_conversation_spreads(spark, monkeypatch):
    # Turns without an id, a snapshot and a copy of them, and one that differs at its end.
    monkeypatch.setattr(chat, "TURNS_EACH", 40, raising=False)
    said = [(t, "user" if t % 2 else "bot", f"text {t}") for t in range(300)]
    rows = [(c, *x) for c, n in ((None, 300), (1, 250), (2, 300), (3, 299)) for x in said[:n]] + [(3, 299, "bot", "another end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_chats(df).collect()}
    lines = [f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, role, text in said]
    assert found == {2: (300, "".join(lines)), 3: (300, "".join([*lines[:299], "<|im_start|>bot\nanother end<|im_end|>\n"]))}
    rolled = chat.rolling_turns(chat.ordered_turns(df))
    assert sorted(r.place for r in rolled.where("conv_id = 2").collect()) == list(range(1, 301))
    assert rolled.where("conv_id = 2").select("part").distinct().count() > 3
    alone = chat.format_chats(df.where("conv_id IS NULL OR conv_id = 1")).collect()
    assert [(r.conv_id, r.n_turns, r.rendered) for r in alone] == [(None, 300, "".join(lines))]


def test_chats_without_an_id_equal_sql(spark, tmp_path):
    rows = [
        (None, 0, "user", "no id"), (None, 1, "assistant", "still none"), (1, 0, "user", "no id"), (2, None, None, None),
        (3, 0, "user", "a"), (3, 1, "user", None), (4, 0, "user", "a"), (4, 1, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = sorted(map(tuple, chat.format_chats(df).collect()), key=str)
    assert found == sorted(con.execute(chat.SQL).fetchall(), key=str)
    assert [r[0] for r in found] == [2, 3, None]


def test_each_pair_is_verified_once(spark, monkeypatch):
    """Copies with changed words share several rare shingles, and so several regions of several blocks."""
    from collections import Counter

    from modelloom.llm import jaccard
    from modelloom.llm.common import key_groups

    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(60)] = f"x{rnd.randrange(30)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moved, orders, seen = [], [], Counter()
    blocks, order = jaccard.in_blocks, jaccard.shingle_order
    monkeypatch.setattr(jaccard, "in_blocks", lambda *a: moved.append(blocks(*a)) or moved[-1])
    monkeypatch.setattr(jaccard, "shingle_order", lambda *a: orders.append(order(*a)) or orders[-1])
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 20)
    like = Likeness(words=3, percent=60)
    found = as_rows(similar_documents(docs, like=like))
    assert found == sorted(plain_components(list(enumerate(texts)), 3, 60), key=str)
    check = jaccard.verified

    def counted(a, b, common, need):
        seen.update((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True))
        return check(a, b, common, need)

    monkeypatch.setattr(jaccard, "verified", counted)
    tasks = moved[-1].toArrow().sort_by([(k, "ascending") for k in jaccard.KEYS])
    groups = list(key_groups(tasks.to_batches(), jaccard.KEYS))
    for group in groups:
        jaccard.links_within(group, orders[0], like)
    assert len(groups) > 3 and len(seen) > 100 and set(seen.values()) == {1}
