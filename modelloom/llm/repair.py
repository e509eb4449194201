"""Repair of damaged conversations by cheapest edits, with prefix-doubling path ranking.

Turns are range-sorted, so that a conversation lies in as many partitions as it fills. A row
is kept, given the other role, or deleted, and turns without text can be put in, such that the
roles read system (if any), user, assistant, user, assistant and so on. Costs to go come from
a dynamic program over rows and the four states of that pattern; the arcs that attain them
carry the letters of an audit. Arcs are ranked by their letter, then by the ranks of twice
as long a piece of audit each round, while a pointer along the least arcs doubles its reach;
the ranks choose the least path, and the pointers lay it out.

A conversation within one partition is solved there, together with its neighbours. For one
that spans several, the least costs between all states are found by partition, chained to costs to go,
and each partition is then solved for itself; only its ends depend on the others.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import checkpointed, key_groups, partitions_for

#: Rows of a partition of the sorted turns at most, on average, and rows that are solved together.
TURNS_EACH, TOGETHER = 100_000, 8192
#: States: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow in each state, and the state after a turn that is put in or given that role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ENDS = np.array([True, False, False, True])
#: Initials of roles as numbers, and the state after keeping such a turn in a state; -1 where it may not stand.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Letters of the audit in the order of their ranks; rank 0 is the end of an audit.
LETTERS = "DIKR"
D, I, K, R = range(1, 5)  # noqa: E741
COST_INSERT, COST_REROLE, COST_DELETE = 2, 2, 3
NEVER = np.int64(1) << 40
SPACE = "\t\n\x0b\x0c\r "
# The fault of a row: its first of these.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass
class Rows:
    """Turns of several conversations, or of pieces of them, one after another."""

    starts: np.ndarray  # of each piece, and the end of the last
    initial: np.ndarray
    fault: np.ndarray
    after: np.ndarray  # costs to go after the last row of each piece, by state
    last: np.ndarray  # whether a piece ends its conversation

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state (axis 1) when turns may be put in first."""
    user = np.minimum(costs[:, USER], COST_INSERT + costs[:, ASSISTANT])
    assistant = np.minimum(costs[:, ASSISTANT], COST_INSERT + costs[:, USER])
    begin = [np.minimum(costs[:, q], COST_INSERT + user) for q in (START, SYSTEM)]
    return np.stack([*begin, user, assistant], axis=1)


def row_costs(rows: Rows, i: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Costs of deleting, keeping and rerolling the rows ``i`` from each state, given those after them."""
    free = ((rows.fault[i] != BLANK) & (rows.fault[i] != DUPLICATE)).reshape(-1, *[1] * (after.ndim - 1))
    cut = (rows.fault[i] == TRUNCATED).astype(np.int64).reshape(free.shape)
    to = KEEP[:, rows.initial[i]].T
    kept = np.take_along_axis(after, np.maximum(to, 0).reshape(*to.shape, *[1] * (after.ndim - 2)), axis=1)
    allowed = free & (to >= 0).reshape(*to.shape, *[1] * (after.ndim - 2))
    return [after + COST_DELETE, np.where(allowed, kept + cut, NEVER), np.where(free, after[:, NEXT] + COST_REROLE + cut, NEVER)]


def costs_to_go(rows: Rows, after: np.ndarray) -> np.ndarray:
    """Least costs from each place and state; a piece of n rows has n + 1 places. ``after`` may have a third axis."""
    lengths = rows.lengths
    places = rows.starts[:-1] + np.arange(len(lengths))
    found = np.empty((int(rows.starts[-1]) + len(lengths), *after.shape[1:]), dtype=np.int64)
    ahead = np.minimum(after, NEVER)
    ending = rows.last.nonzero()[0]
    ahead[ending] = closed(ahead[ending])
    found[places + lengths] = ahead
    order = np.argsort(-lengths, kind="stable")
    for step in range(1, int(lengths.max(initial=0)) + 1):
        order = order[: np.searchsorted(-lengths[order], -step, side="right")]
        i = rows.starts[order + 1] - step
        best = np.minimum.reduce(row_costs(rows, i, found[places[order] + lengths[order] - step + 1]))
        found[places[order] + lengths[order] - step] = np.minimum(closed(best), NEVER)
    return found


def transfers(rows: Rows) -> np.ndarray:
    """The least cost from each state before a piece to each state after it."""
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    middle = Rows(rows.starts, rows.initial, rows.fault, rows.after, np.zeros(len(rows.last), dtype=bool))
    found = costs_to_go(middle, np.broadcast_to(unit, (len(rows.last), 4, 4)).copy())
    return found[rows.starts[:-1] + np.arange(len(rows.last))]


def optimal_arcs(rows: Rows, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets (nodes by 4 letters, -1 for no arc) of the arcs that attain the costs, and the row of each node.

    Node 4 * place + state. The letters of a node's arcs differ, so an audit names one path.
    """
    lengths = rows.lengths
    place = np.arange(len(costs))
    piece = np.repeat(np.arange(len(lengths)), lengths + 1)
    row = place - piece
    at_end = row == rows.starts[piece + 1]
    target = np.full((len(costs), 4, 4), -1, dtype=np.int64)
    inner = (~at_end).nonzero()[0]
    options = row_costs(rows, row[inner], costs[inner + 1])
    to = KEEP[:, rows.initial[row[inner]]].T
    here = costs[inner]
    for letter, cost, state in ((D, options[0], np.broadcast_to(np.arange(4), to.shape)), (K, options[1], to), (R, options[2], np.broadcast_to(NEXT, to.shape))):
        target[inner, :, letter - 1] = np.where((cost == here) & (here < NEVER), 4 * (inner[:, None] + 1) + state, -1)
    # Nothing is put in at the end of a piece whose conversation goes on: the next piece does that.
    open_ = (~at_end | rows.last[piece]).nonzero()[0]
    put_in = (costs[open_][:, NEXT] + COST_INSERT == costs[open_]) & (costs[open_] < NEVER)
    target[open_, :, I - 1] = np.where(put_in, 4 * open_[:, None] + NEXT, -1)
    return target.reshape(-1, 4), row


def least_paths(target: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least path from each start node: for every step its path, its letter and the node it leaves.

    Nodes of the ranking are the arcs, and one end without a letter. A node's least arc follows
    from the ranks; the pointer of an arc leads to the least arc of its target.
    """
    node, letter = (target >= 0).nonzero()
    end = len(node)
    letter = np.append(letter + 1, 0)
    first = np.full(len(target), end, dtype=np.int64)
    rank = letter.copy()
    np.minimum.at(best := np.full(len(target), 5, dtype=np.int64), node, rank[:-1])
    least = (rank[:-1] == best[node]).nonzero()[0]
    first[node[least]] = least
    pointer = np.append(first[target[node, letter[:-1] - 1]], end)
    pointers, reach = [pointer], 1
    entry = first[starts]
    # Ranks of pieces of 2, 4, 8 ... letters, until all pointers are at the end.
    while (pointer != end).any():
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1].reshape(-1)
        # Of a node's arcs the one of least rank; longer pieces only confirm it, as letters differ.
        order = np.lexsort((rank[:-1], node))
        lead = order[np.append(True, node[order][1:] != node[order][:-1])] if len(order) else order
        first[node[lead]] = lead
        entry = first[starts]
        pointer = pointer[pointer]
        pointers.append(pointer)
        reach *= 2
    path, step, arc = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64), entry
    going = arc != end
    path, step, arc = path[going], step[going], arc[going]
    for k, jump in enumerate(pointers):
        further = jump[arc]
        more = (further != end).nonzero()[0]
        path, step, arc = np.append(path, path[more]), np.append(step, step[more] + (1 << k)), np.append(arc, further[more])
    order = np.lexsort((step, path))
    return path[order], letter[arc[order]], node[arc[order]]


def initials_of(roles: pa.Array) -> np.ndarray:
    heads = pc.utf8_slice_codeunits(roles, 0, 1)
    return pc.fill_null(pc.index_in(heads, pa.array(list(INITIALS))), OTHER).to_numpy(zero_copy_only=False).astype(np.int64)


def faults_of(texts: pa.Array, seen: np.ndarray) -> np.ndarray:
    said = pc.utf8_trim(texts, SPACE)
    blank = pc.equal(pc.binary_length(said), 0).to_numpy(zero_copy_only=False)
    whole = pc.is_in(pc.utf8_slice_codeunits(said, -1, 1 << 30), pa.array([".", "!", "?"])).to_numpy(zero_copy_only=False)
    return np.where(blank, BLANK, np.where(seen, DUPLICATE, np.where(whole, FINE, TRUNCATED)))


def illegal_pairs(initial: np.ndarray) -> np.ndarray:
    """Whether each row but the first stands badly after the one before it."""
    a, b = initial[:-1], initial[1:]
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


def repeats(piece: np.ndarray, *columns: pa.Array) -> np.ndarray:
    """Rows equal in all columns to an earlier one of their piece."""
    known: set = set()
    found = np.zeros(len(piece), dtype=bool)
    for i, key in enumerate(zip(piece.tolist(), *(c.to_pylist() for c in columns), strict=True)):
        found[i] = key in known
        known.add(key)
    return found


def edited(rows: Rows, entry: np.ndarray, roles: list[str], texts: list[str], costs: np.ndarray) -> list[tuple[str, list[str]]]:
    """Audit and repaired turns of each piece, entered in the states ``entry``."""
    target, row_of = optimal_arcs(rows, costs)
    places = rows.starts[:-1] + np.arange(len(entry))
    path, letter, node = least_paths(target, 4 * places + entry)
    out: list[tuple[list[str], list[str]]] = [([], []) for _ in entry]
    for p, a, row, state in zip(path.tolist(), letter.tolist(), row_of[node // 4].tolist(), (node % 4).tolist(), strict=True):
        audit, turns = out[p]
        audit.append(LETTERS[a - 1])
        if a == K:
            turns.append(f"{roles[row]}:{texts[row]}")
        elif a == R or a == I:
            turns.append(f"{'assistant' if state == USER else 'user'}:{texts[row] if a == R else ''}")
    return [("".join(audit), turns) for audit, turns in out]


def exits(rows: Rows, costs: np.ndarray) -> np.ndarray:
    """The state after each piece, for each state before it."""
    target, _ = optimal_arcs(rows, costs)
    places = rows.starts[:-1] + np.arange(len(rows.last))
    starts = (4 * places[:, None] + np.arange(4)).reshape(-1)
    path, letter, node = least_paths(target, starts)
    found = np.tile(np.arange(4), len(places))
    last = np.append(path[1:] != path[:-1], True).nonzero()[0] if len(path) else np.zeros(0, dtype=np.int64)
    found[path[last]] = target[node[last], letter[last] - 1] % 4
    return found.reshape(-1, 4)


def damaged(turns: DataFrame, key: Column) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by the CRC of ``key``: a fifth of the rows lose, gain or change something."""
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("__n"))
    return rows.where("__n > 0").withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).drop("__n")


def named(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """The four columns by their usual names; null roles and texts are one space."""
    words = [F.coalesce(col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))]
    return turns.select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), *words)


def damage_key(conv: str = "conv_id", turn: str = "turn") -> Column:
    """``conv_id:turn``, a null being one space."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])


def ordered(turns: DataFrame) -> DataFrame:
    """The turns range-sorted and written once, with their partition ``part`` and an ``id`` that follows the order.

    Equal rows can fall into different partitions, so copies of one are no hot key.
    """
    spark = turns.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    apart = turns.withColumn("__apart", F.monotonically_increasing_id())
    parts = max(least, partitions_for(turns.select("conv_id").count(), TURNS_EACH))
    rows = apart.repartitionByRange(parts, *order, "__apart").sortWithinPartitions(*order).drop("__apart")
    return checkpointed(rows).withColumn("part", F.spark_partition_id().cast("long")).withColumn("id", F.monotonically_increasing_id())


def whole_conversations(rows: DataFrame) -> DataFrame:
    """Repairs of conversations that lie in one partition each; a task reads its rows in order."""
    schema = rows.select("conv_id").schema
    for name in COLUMNS.split(", "):
        schema.add(*name.split(" "))
    source = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").isNull().alias("none"), "role", "text", F.col("turn").cast("long").alias("turn"))

    def run(batches):
        held, size = [], 0
        for group in key_groups(batches, ["none", "key"]):
            held.append(group)
            size += group.num_rows
            if size >= TOGETHER:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    def solve(groups: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(groups).combine_chunks()
        starts = np.cumsum([0, *(g.num_rows for g in groups)])
        column = {name: table[name].combine_chunks() for name in ("role", "text")}
        piece = np.repeat(np.arange(len(groups)), np.diff(starts))
        initial = initials_of(column["role"])
        fault = faults_of(column["text"], repeats(piece, column["role"], column["text"]))
        after = np.tile(np.where(ENDS, 0, NEVER), (len(groups), 1))
        found = Rows(starts, initial, fault, after, np.ones(len(groups), dtype=bool))
        costs = costs_to_go(found, after)
        texts = edited(found, np.zeros(len(groups), dtype=np.int64), column["role"].to_pylist(), column["text"].to_pylist(), costs)
        bad = illegal_pairs(initial) & (piece[1:] == piece[:-1])
        arrays = [
            pa.concat_arrays([c for g in groups for c in g["conv_id"].slice(0, 1).chunks]),
            pa.array([turn_gaps(g["turn"]) for g in groups], pa.int64()),
            *(pa.array(np.bincount(piece, fault == kind, len(groups)).astype(np.int64)) for kind in (BLANK, DUPLICATE, TRUNCATED)),
            pa.array(np.bincount(piece[1:], bad, len(groups)).astype(np.int64)),
            pa.array(costs[starts[:-1] + np.arange(len(groups)), START]),
            pa.array([audit for audit, _ in texts]),
            pa.array([hashlib.sha256("\n".join(turns).encode()).hexdigest() for _, turns in texts]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def turn_gaps(turns) -> int:
    present = np.unique(turns.drop_null().to_numpy())
    return int(present[-1]) - int(present[0]) + 1 - len(present) if len(present) else 0


def spanning_conversations(rows: DataFrame) -> DataFrame:
    """Repairs of conversations that go on over several partitions, joined from those of their pieces."""
    same = ["conv_id", "part"]
    number = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(OTHER)
    digests = [F.xxhash64(F.lit(i), "role", "text").alias(f"h{i}") for i in (1, 2)]
    said = F.trim(F.col("text"), F.lit(SPACE))
    light = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").isNull().alias("none"), *same, "id",
        F.col("turn").cast("long").alias("turn"), number.cast("long").alias("initial"), (said == "").alias("blank"), F.right(said, F.lit(1)).isin(".", "!", "?").alias("ended"), *digests,
    )
    conv = ["none", "key"]
    # Of each content the first row of every piece; those of later pieces are repeats as well.
    content = light.groupBy(*conv, "h1", "h2", "part").agg(F.min("id").alias("id"))
    earliest = content.groupBy(*conv, "h1", "h2").agg(F.min("id").alias("first"))
    firsts = earliest.select(F.col("first").alias("id"), F.lit(True).alias("new"))
    light = checkpointed(light.join(firsts, "id", "left").drop("h1", "h2"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("ended"), FINE).otherwise(TRUNCATED)
    light = light.withColumn("fault", fault.cast("long"))
    pieces = light.select(*conv, "part", "id", "initial", "fault")
    last = light.groupBy(*conv).agg(F.max("part").alias("last_part"))

    def rows_of(table: pa.Table, after: np.ndarray, ends: bool) -> Rows:
        return Rows(np.array([0, table.num_rows]), table["initial"].to_numpy(), table["fault"].to_numpy(), after, np.array([ends]))

    def key_of(table: pa.Table) -> dict:
        return {name: [table[name][0].as_py()] for name in ("none", "key", "part")}

    def between(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return pa.table(key_of(table) | {"costs": pa.array(transfers(rows_of(table, np.zeros((1, 4), dtype=np.int64), False)).reshape(1, 16).tolist(), pa.list_(pa.int64()))})

    key = "none boolean, key string, part long"
    matrices = pieces.groupBy(*conv, "part").applyInArrow(between, f"{key}, costs array<long>")

    def chain(table: pa.Table) -> pa.Table:
        """Costs to go after each piece: one small matrix per piece, from the last to the first."""
        table = table.sort_by("part")
        after, found = np.where(ENDS, 0, NEVER), []
        after = closed(after[None])[0]
        for matrix in reversed(table["costs"].to_pylist()):
            found.append(after.tolist())
            after = np.minimum((np.array(matrix).reshape(4, 4) + after).min(axis=1), NEVER)
        return table.select(["none", "key", "part"]).append_column("after", pa.array(found[::-1], pa.list_(pa.int64()))).append_column("total", pa.array([int(after[START])] * table.num_rows))

    ahead = matrices.groupBy(*conv).applyInArrow(chain, f"{key}, after array<long>, total long")
    ahead = checkpointed(ahead.join(last, conv).withColumn("ends", F.col("part") == F.col("last_part")).drop("last_part"))
    joined = pieces.join(ahead, [*conv, "part"])

    def prepared(table: pa.Table) -> tuple[pa.Table, Rows, np.ndarray]:
        table = table.sort_by("id")
        after = np.array([table["after"][0].as_py()], dtype=np.int64)
        found = rows_of(table, after, table["ends"][0].as_py())
        # Costs after the last piece are closed already, and stay so.
        return table, found, costs_to_go(found, after)

    def leave(table: pa.Table) -> pa.Table:
        table, found, costs = prepared(table)
        return pa.table(key_of(table) | {"exits": pa.array(exits(found, costs).tolist(), pa.list_(pa.int64()))})

    def follow(table: pa.Table) -> pa.Table:
        """The state in which each piece is entered."""
        table = table.sort_by("part")
        state, found = START, []
        for after in table["exits"].to_pylist():
            found.append(state)
            state = after[state]
        return table.select(["none", "key", "part"]).append_column("entry", pa.array(found, pa.int64()))

    left = joined.groupBy(*conv, "part").applyInArrow(leave, f"{key}, exits array<long>")
    entered = checkpointed(left.groupBy(*conv).applyInArrow(follow, f"{key}, entry long"))
    joined = joined.join(entered, [*conv, "part"])

    def decide(table: pa.Table) -> pa.Table:
        """For each row the roles put in before it, its letter and role; what is put in at the end stands under a row of its own."""
        table, found, costs = prepared(table)
        target, row_of = optimal_arcs(found, costs)
        _, letter, node = least_paths(target, np.array([table["entry"][0].as_py()]))
        ids, edits = [*table["id"].to_pylist(), None], {}
        for a, row, state in zip(letter.tolist(), row_of[node // 4].tolist(), (node % 4).tolist(), strict=True):
            edits.setdefault(row, []).append((LETTERS[a - 1], "assistant" if state == USER else "user"))
        rows_ = sorted(edits)
        at = [2 * ids[r] if ids[r] is not None else 2 * ids[-2] + 1 for r in rows_]
        fields = {"at": pa.array(at, pa.int64())}
        fields |= {"id": pa.array([ids[r] for r in rows_], pa.int64()), "letters": pa.array(["".join(x for x, _ in edits[r]) for r in rows_])}
        fields |= {"roles": pa.array([[y for _, y in edits[r]] for r in rows_], pa.list_(pa.string()))}
        many = len(rows_)
        return pa.table({name: v * many for name, v in key_of(table).items()} | fields)

    edits = joined.groupBy(*conv, "part").applyInArrow(decide, f"{key}, at long, id long, letters string, roles array<string>")
    spoken = edits.join(rows.select("id", "role", "text"), "id", "left")
    own, put_in = F.right("letters", F.lit(1)), F.expr("slice(roles, 1, size(filter(split(letters, ''), x -> x = 'I')))")
    turns = F.concat(
        F.transform(put_in, lambda r: F.concat(r, F.lit(":"))),
        F.when(own == "K", F.array(F.concat("role", F.lit(":"), "text")))
        .when(own == "R", F.array(F.concat(F.element_at("roles", -1), F.lit(":"), "text")))
        .otherwise(F.array().cast("array<string>")),
    )
    spoken = spoken.select(*conv, "part", F.struct("at", "letters", turns.alias("turns")).alias("x"))
    by_piece = spoken.groupBy(*conv, "part").agg(F.sort_array(F.collect_list("x")).alias("x"))
    by_piece = by_piece.select(
        *conv, "part", F.array_join(F.transform("x", lambda x: x["letters"]), "").alias("audit"),
        F.size(F.flatten(F.transform("x", lambda x: x["turns"]))).alias("n"), F.array_join(F.flatten(F.transform("x", lambda x: x["turns"])), "\n").alias("repaired"),
    )

    def join_up(batches):
        """Audits and digests of conversations whose pieces come in order; texts are hashed as they come."""
        none = key_ = digest = None
        for batch in batches:
            for n, k, audit, many, text in zip(*(batch.column(c).to_pylist() for c in ("none", "key", "audit", "n", "repaired")), strict=True):
                if (n, k) != (none, key_):
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"none": none, "key": key_, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}])
                    none, key_, audits, digest, some = n, k, [], hashlib.sha256(), False
                audits.append(audit)
                if many:
                    digest.update(("\n" if some else "").encode() + text.encode())
                    some = True
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"none": none, "key": key_, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}])

    sorted_pieces = by_piece.repartition(*conv).sortWithinPartitions(*conv, "part")
    written = sorted_pieces.mapInArrow(join_up, "none boolean, key string, audit string, repaired_sha256 string")
    # Within a piece a window gives each row's neighbour; between pieces the ends are compared.
    within = Window.partitionBy(*conv, "part").orderBy("id")
    pairs = light.select(*conv, "part", "id", "initial", F.lag("initial").over(within).alias("before"))
    ends = light.groupBy(*conv, "part").agg(F.min_by("initial", "id").alias("initial"), F.max_by("initial", "id").alias("last"))
    ends = ends.select(*conv, "initial", F.lag("last").over(Window.partitionBy(*conv).orderBy("part")).alias("before"))
    fits = F.concat(F.col("before").cast("string"), F.col("initial").cast("string")).isin("01", "12", "21")
    both = pairs.select(*conv, "initial", "before").union(ends).where("before IS NOT NULL")
    illegal = both.groupBy(*conv).agg(F.count_if(~fits).alias("illegal"))
    counts = [F.count_if(F.col("fault") == kind).alias(name) for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))]
    faults = light.groupBy(*conv).agg(*counts)
    distinct = light.select(*conv, "turn").distinct().groupBy(*conv).agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("turn").alias("n"))
    gaps = distinct.select(*conv, F.coalesce(F.col("b") - F.col("a") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    cost = ahead.groupBy(*conv).agg(F.max("total").alias("cost"))
    ids = rows.select("conv_id").distinct().select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").isNull().alias("none"))
    found = ids
    for table in (gaps, faults, illegal, cost, written):
        found = found.join(table, conv, "left")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0).cast("long")).alias("illegal"), "cost", "audit", "repaired_sha256")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    ``turns(conv_id, turn, role, text)``, as ``named`` gives them. Rows are taken by turn (null first), those
    of one turn by role and text; rows without a conversation id are one conversation, whose id is
    null. A row's first fault counts: blank, equal to an earlier one in role and text, or without
    ``.!?`` at its end. Blank and repeated rows are deleted, others kept, given the other role or deleted
    as the cheapest edits demand; of equally cheap ones the audit that is least in ASCII. Whatever
    begins with s, u or a stands for system, user or assistant; other roles can't stay. Audit and digest
    of a conversation are one value each; its texts meet piece by piece.
    """
    rows = ordered(turns)
    parts = rows.groupBy("conv_id", "part").agg(F.lit(1).alias("x"))
    spans = checkpointed(parts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("long_id")))
    # At most one conversation goes on from a partition to the next.
    few = spans.count()
    if few == 0:
        return whole_conversations(rows)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    inside = rows.join(F.broadcast(spans), same, "left_anti")
    across = rows.join(F.broadcast(spans), same, "left_semi")
    return whole_conversations(inside).unionByName(spanning_conversations(across))


def with_missing(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """``found``, and conversations of which no row is left: no faults, no edits, the digest of nothing."""
    every = conversations.select(F.col("conv_id").alias("__conv")).distinct()
    joined = every.join(found, F.col("__conv").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    rest = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256")]
    return joined.select(F.col("__conv").alias("conv_id"), *zeros, *rest)


def damage_and_repair(turns: DataFrame, **columns: str) -> DataFrame:
    """Every conversation damaged by its own key and repaired; see ``damaged`` and ``repair_conversations``.

    Nulls in keys, roles and texts are one space. Other columns are ignored, equal rows count each, an
    empty table gives no rows.
    """
    rows = named(turns, **columns)
    return with_missing(repair_conversations(damaged(rows, damage_key())), rows)
