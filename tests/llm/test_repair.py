"""Conversation repair against a plain search over cost, audit and turns."""

import hashlib
import random
import zlib

import pytest

from modelloom.llm.queries import QUERIES
from modelloom.llm.repair import damage_and_repair
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
FOLLOWS = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        words = [" " if v is None else v for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{words[0]}:{words[1]}".encode()) % 20
        role, text = words[2:]
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return found


def cheapest(rows, faults):
    """Cost, audit and linked turns from each state, from the last row to the first."""
    ahead = None
    for i in range(len(rows), -1, -1):
        options = {q: [] for q in range(4)}
        for q in range(4):
            if i == len(rows):
                options[q] += [(0, "", ())] if q in (0, 3) else []
                continue
            _, role, text = rows[i]
            extra = int(faults[i] == "truncated")
            cost, audit, turns = ahead[q]
            options[q].append((cost + 3, "D" + audit, turns))
            if faults[i] in ("blank", "duplicate"):
                continue
            moves = [("K", KEEPS[q, role[:1]], role, extra)] if (q, role[:1]) in KEEPS else []
            for letter, to, said_by, more in [*moves, ("R", *FOLLOWS[q], 2 + extra)]:
                cost, audit, turns = ahead[to]
                options[q].append((cost + more, letter + audit, (f"{said_by}:{text}", turns)))
        here = {q: min(o, default=(10**9, "", ())) for q, o in options.items()}
        for _ in range(4):
            put_in = {q: (here[to][0] + 2, "I" + here[to][1], (f"{role}:", here[to][2])) for q, (to, role) in FOLLOWS.items()}
            here = {q: min([*options[q], put_in[q]]) for q in range(4)}
        ahead = here
    return ahead[0]


def brute(table):
    found = {}
    for conv, rows in damage(table).items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            said = text.strip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = {t for t, _, _ in rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
        cost, audit, linked = cheapest(rows, faults)
        turns = []
        while linked:
            turns.append(linked[0])
            linked = linked[1]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return found


def random_rows(rnd, convs, n):
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "s", "ü"]
    texts = ["Hi.", "ok", "  ", None, "", "yes!\n", "What? ", "x", "y", "no."]
    for _ in range(n):
        turn = rnd.choice([None, *range(12)]) if rnd.random() < 0.5 else rnd.randrange(1000)
        text = rnd.choice(texts) if rnd.random() < 0.6 else f"t{rnd.randrange(40)}."
        yield rnd.choice(convs), turn, rnd.choice(roles[:5] if rnd.random() < 0.7 else roles), text


CASES = {
    "many": list(random_rows(random.Random(1), [None, *range(300)], 1800)),
    "one long": list(random_rows(random.Random(2), [None, 1, 1, 1, 1, 2, 3], 900)),
    "copies": [(None,) * 4] * 200 + [(1, 1, "user", "x.")] * 200 + list(random_rows(random.Random(3), [1, 2], 40)),
}


@pytest.mark.parametrize("parts", [3, 24])
@pytest.mark.parametrize("case", CASES)
def test_equals_plain_search(spark, case, parts):
    """With few rows a partition, conversations and runs of equal rows go on over many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(CASES[case], SCHEMA).selectExpr("*", "1 AS COST", "'x' AS PART", "'y' AS ID")
        found = {r.conv_id: tuple(r)[1:] for r in damage_and_repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == brute(CASES[case])


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    found = QUERIES["op13_conversation_repair"](spark, DATA).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == brute(rows) and len(found) == len({r[0] for r in rows})


def test_empty(spark):
    assert damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
