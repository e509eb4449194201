"""Similarity join of documents by the Jaccard likeness of their word shingles.

Two documents link when the likeness of their shingle sets reaches a threshold. The join
is exact, up to coincidences of 64-bit hashes:

1. Documents with equal sets fall together into one node, however many they are.
2. Shingles are ordered rare first, by counts over the whole table in a hash table of
   fixed size (any common order is right; a good one is merely fast), then by their hash.
3. Two linked sets share a shingle within the first ``n - ceil(t * n) + 1`` of each
   (prefix filter). All nodes that have a prefix shingle in common meet in the region of
   its smallest node. Nearly equal documents mostly share one smallest node, so a node
   joins few regions, and the rows that are moved grow with the nodes, not with the pairs.
4. Large regions are cut into blocks of bounded size, each pair of blocks is a task of its
   own. First only sketches go there, a byte for some eight shingles: the length filter and
   the suffix filter leave the nodes that may have a partner in the region.
5. The shingle sets of those nodes are fetched and meet in the same way. There, pairs pass
   the prefix, length and positional filters and are then verified exactly. A block reports
   a star for each component of its links.
6. Connected components of the stars are those of all links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import (
    checkpointed,
    in_parts,
    key_groups,
    list_array,
    list_parts,
    shingles,
    word_hashes,
    words_of,
)
from modelloom.llm.components import connected_components

#: Counters of the shingle order, shingles and nodes in a block, bits of the filter of needed
#: rows, columns of one dense product, shingles for a byte of a sketch and its least length.
COUNTERS, BLOCK, BLOCK_NODES, FILTER_BITS, COLUMNS, PER_BIN, LEAST_BINS = 1 << 18, 500_000, 1500, 1 << 22, 2048, 8, 16
KEYS = ["region", "low", "high"]


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words, linked from ``percent`` / 100 on; ``lower``: A-Z as a-z."""

    words: int = 5
    percent: int = 80
    lower: bool = True

    def shingle_set(self, text: str | None) -> np.ndarray:
        if text and self.lower:
            text = text.encode().lower().decode()
        return np.unique(shingles(word_hashes(words_of(text)), self.words))

    def prefix_length(self, n):
        return n - -(-self.percent * n // 100) + 1


def set_key(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set; 0 for the empty one, never 0 for others."""
    return (int(word_hashes([found.tobytes()]).view(np.int64)[0]) or 1) if len(found) else 0


def row_hash(*columns: str):
    return F.xxhash64(*[col(c) for c in columns])


def shingle_order(docs: DataFrame, text_col: str, like: Likeness) -> np.ndarray:
    """Counts of all shingles of the table by their last bits; ``COUNTERS`` numbers, whatever the table."""

    def count(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in in_parts(batches, 0):
            for text in batch.column(0).to_pylist():
                found = (like.shingle_set(text) & np.uint64(COUNTERS - 1)).astype(np.int64)
                np.add.at(total, found, 1)
        (used,) = np.nonzero(total)
        for a in range(0, len(used), 10_000):
            part = used[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["counter", "n"])

    texts = docs.select(col(text_col).cast("string")).where(col(text_col).isNotNull())
    sums = texts.mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counters = np.zeros(COUNTERS, dtype=np.int64)
    found = sums.toArrow()
    counters[found["counter"].to_numpy()] = found["n"].to_numpy()
    return counters


def rare_first(found: np.ndarray, counters: np.ndarray) -> np.ndarray:
    return found[np.lexsort((found, counters[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]))]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """``(id, row_hash, n_shingles, component_id, component)`` for every row of ``docs``.

    ``row_hash`` is the hash of id and text, ``component_id`` the smallest id that links
    reach from the row, itself included, ``component`` a number that linked rows share, null
    for rows without a shingle. Null and empty texts have no shingle and are linked
    with nothing; rows with fewer words than a shingle have their whole sequence as one.
    Equal rows, and rows that share an id, are rows of their own: equal sets are linked.
    Rows without an id take part; a component of such rows alone has a null id. An empty
    table gives no rows. Only counts, two tables of fixed size and sums reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row_hash", row_hash("id", "text"))
    counters = spark.sparkContext.broadcast(shingle_order(rows, "text", like))

    def sets(batches):
        order, seen = counters.value, set()
        for batch in in_parts(batches, 2):
            found = [like.shingle_set(t) for t in batch.column(2).to_pylist()]
            keys = [set_key(f) for f in found]
            # A task gives the prefix of each set once, so that copies are no hot key below.
            prefixes = []
            for f, key in zip(found, keys, strict=True):
                prefixes.append(rare_first(f, order)[: like.prefix_length(len(f))] if len(f) and key not in seen else f[:0])
                seen.add(key)
            lists = list_array(np.concatenate(prefixes).view(np.int64), [len(p) for p in prefixes])
            nodes, sizes = pa.array(keys, pa.int64()), pa.array([len(f) for f in found], pa.int64())
            sketches = pa.array([sketch(f) for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, sizes, sketches, lists], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    # Both uses below need the same Python pass. Cached blocks that are lost are made again.
    names = ["id", "row_hash", "node", "n", "sketch", "prefix"]
    schema = f"id {kind}, row_hash long, node long, n long, sketch binary, prefix array<long>"
    found = rows.select("id", "row_hash", "text").mapInArrow(sets, schema).persist()
    members = checkpointed(found.select("id", "row_hash", "node", "n"))
    prefixes = found.select("node", F.explode("prefix").alias("token"))
    shared = prefixes.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    regions = checkpointed(prefixes.join(shared, "token").select(F.col("low").alias("region"), "node").distinct())
    needed = found.join(regions.select("node").distinct(), "node").groupBy("node")
    nodes = checkpointed(needed.agg(F.min("row_hash").alias("row_hash"), F.max("n").alias("n"), F.first("sketch").alias("sketch")))
    found.unpersist()

    regions = likely_regions(regions, nodes, like)
    nodes = nodes.join(regions.select("node").distinct(), "node").select("node", "row_hash", "n")
    links = block_links(rows, nodes, regions, counters, like)
    nodes = members.groupBy("node").agg(F.min("id").alias("least"))
    component = connected_components(links).withColumnRenamed("component", "root")
    joined = nodes.join(component, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("node", "component_id", "root")
    alone = F.col("node") == 0
    own = F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    component = F.when(~alone, F.col("root")).alias("component")
    # A node of very many equal documents is a skewed key of this join, which Spark splits.
    return members.join(named, "node").select("id", "row_hash", F.col("n").alias("n_shingles"), own, component)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component its smallest id stays.

    Of rows with the same id in a component one stays, null ids come last. Rows without a
    shingle all stay. Rows that repeat id and text are one document; one of them stays.
    """
    found = similar_documents(docs, id_col, text_col, like)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_hash")).alias("first")
    kept = found.where("component IS NOT NULL").groupBy("component").agg(first).select("first.row_hash")
    kept = kept.union(found.where("component IS NULL").select("row_hash")).distinct()
    name = "__row_hash"
    hashed = docs.withColumn(name, F.xxhash64(col(id_col), col(text_col).cast("string")))
    # Repeated rows fold together within their tasks, before the only shuffle of texts.
    single = hashed.dropDuplicates([name])
    return single.join(kept.withColumnRenamed("row_hash", name), name, "left_semi").select(*[col(c) for c in docs.columns])


def sketch(found: np.ndarray) -> bytes:
    """Sizes, up to 255, of the parts into which hash bits split a set; a power of two of them."""
    bins = max(LEAST_BINS, 1 << (len(found) // PER_BIN).bit_length())
    counts = np.bincount((found >> np.uint64(40)).astype(np.int64) & (bins - 1), minlength=bins)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def in_blocks(regions: DataFrame, nodes: DataFrame, weight, payload: DataFrame) -> DataFrame:
    """Rows of ``payload`` for each pair of blocks of a region, sorted by ``region, low, high``."""
    sizes = regions.join(nodes.select("node", weight.alias("weight")), "node")
    sizes = sizes.groupBy("region").agg(F.sum("weight").alias("weight"), F.count("*").alias("nodes"))
    blocks = F.ceil(F.greatest(F.col("weight") / BLOCK, F.col("nodes") / BLOCK_NODES)).cast("int")
    placed = regions.join(sizes.select("region", blocks.alias("blocks")), "region")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = placed.select("node", "region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    tasks = tasks.join(payload, "node").select(*KEYS, "own", *payload.columns)
    return tasks.repartition(*KEYS).sortWithinPartitions(*KEYS)


def likely_regions(regions: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """The regions' nodes that the length and suffix filters leave with a partner there.

    A pair that has several regions in common counts in the smallest of them only.
    """

    def likely(batches):
        for group in key_groups(batches, KEYS):
            node = group["node"].to_numpy()[with_partner(group, like)]
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), group["region"][0].as_py())), pa.array(node)], names=["region", "node"])

    # A node has no more regions than prefix shingles.
    all_regions = regions.groupBy("node").agg(F.collect_set("region").alias("regions"))
    payload = nodes.join(all_regions, "node").select("node", "n", "sketch", "regions")
    tasks = in_blocks(regions, nodes, F.col("n") / PER_BIN, payload)
    return checkpointed(tasks.mapInArrow(likely, "region long, node long").distinct())


def with_partner(group: pa.Table, like: Likeness) -> np.ndarray:
    """Whether each node has another in its block, or in the other one, that it may be linked with.

    Sets that hash bits split into parts differ by at least the differences of the parts'
    sizes. A finer sketch is folded to the parts of a coarser one.
    """
    n, own = group["n"].to_numpy(), group["own"].to_numpy()
    same = group["low"][0].as_py() == group["high"][0].as_py()
    sketches = [np.frombuffer(x, dtype=np.uint8).astype(np.int16) for x in group["sketch"].to_pylist()]
    order = np.argsort(n, kind="stable")
    found = np.zeros(len(n), dtype=bool)
    flat, offsets = list_parts(group["regions"].combine_chunks())
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    smaller, all_ = flat < group["region"][0].as_py(), np.arange(len(n))
    elsewhere = overlaps(doc[smaller], flat[smaller], len(n), all_, all_) > 0 if smaller.any() else None
    folded: dict[int, tuple[int, np.ndarray]] = {}
    for place, i in enumerate(order.tolist()):
        end = int(np.searchsorted(n[order], n[i] * 100 // like.percent, side="right"))
        if place + 1 >= end:
            continue
        bins = len(sketches[i])
        first, matrix = folded.get(bins, (0, None))
        if matrix is None or end > first + len(matrix):
            # All that a set of this many parts may be compared with: the rest of this size and the next ones.
            most = int(np.searchsorted(n[order], bins * PER_BIN * 100 // like.percent, side="right"))
            first, matrix = place, np.array([fold(sketches[j], bins) for j in order[place : max(end, most)].tolist()])
            folded = {bins: (first, matrix)}
        others = order[place + 1 : end]
        differ = np.abs(matrix[place + 1 - first : end - first] - matrix[place - first]).sum(axis=1)
        need = -(-like.percent * (n[i] + n[others]) // (100 + like.percent))
        fits = n[i] + n[others] - differ >= 2 * need
        if not same:
            fits &= own[others] != own[i]
        if elsewhere is not None:
            fits &= ~elsewhere[i, others]
        found[others[fits]] = True
        found[i] |= fits.any()
    return found


def fold(parts: np.ndarray, bins: int) -> np.ndarray:
    while len(parts) > bins:
        parts = np.minimum(parts[: len(parts) // 2] + parts[len(parts) // 2 :], 255)
    return parts


def block_links(rows: DataFrame, nodes: DataFrame, regions: DataFrame, counters, like: Likeness) -> DataFrame:
    """Edges ``(a, b)`` between nodes, enough to connect all that are linked."""
    spark = rows.sparkSession
    nodes = checkpointed(nodes)
    # One bit for each hash value of a needed row: a filter of fixed size before texts are read again.
    bits = nodes.select(F.pmod("row_hash", F.lit(FILTER_BITS)).alias("bit"))
    parts = bits.selectExpr("CAST(bit DIV 64 AS INT) AS part", "shiftleft(1L, CAST(bit % 64 AS INT)) AS bits")
    parts = parts.groupBy("part").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[parts["part"].to_numpy()] = parts["bits"].to_numpy()
    shared_table = spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool))

    def sets(batches):
        for batch in in_parts(batches, 1):
            hashes = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(shared_table.value[hashes % FILTER_BITS]))
            found = [like.shingle_set(t) for t in batch.column(1).to_pylist()]
            if found:
                keys = pa.array([set_key(f) for f in found], pa.int64())
                lists = list_array(np.concatenate(found).view(np.int64), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([keys, lists], names=["node", "tokens"])

    # Equal sets fold together before the shuffle; those let through by chance find no region.
    texts = rows.select("row_hash", "text").mapInArrow(sets, "node long, tokens array<long>")
    texts = texts.groupBy("node").agg(F.first("tokens").alias("tokens"))
    texts = texts.join(regions.groupBy("node").agg(F.collect_set("region").alias("regions")), "node")
    tasks = in_blocks(regions, nodes, F.col("n"), texts)

    def link(batches):
        for group in key_groups(batches, KEYS):
            a, b = links_within(group, counters.value, like)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return checkpointed(tasks.mapInArrow(link, "a long, b long").distinct())


def links_within(group: pa.Table, counters: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links within a block or between two blocks.

    A pair is verified in the smallest region that its two nodes have in common. Each pair that
    the filters could keep has kept both nodes in that region, so none is lost.
    """
    node, own = group["node"].to_numpy(), group["own"].to_numpy()
    flat, offsets = list_parts(group["tokens"].combine_chunks())
    n, m = np.diff(offsets).astype(np.int32), len(node)
    doc = np.repeat(np.arange(m), n)
    distinct, token = np.unique(flat.view(np.uint64), return_inverse=True)
    rank = np.empty(len(distinct), dtype=np.int64)
    rank[np.lexsort((distinct, counters[(distinct & np.uint64(COUNTERS - 1)).astype(np.int64)]))] = np.arange(len(distinct))
    order = np.lexsort((rank[token], doc))
    token = rank[token][order]
    prefix = like.prefix_length(n)
    in_prefix = np.arange(len(token)) - offsets[:-1][doc] < prefix[doc]

    low, high = group["low"][0].as_py(), group["high"][0].as_py()
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    common = overlaps(doc[in_prefix], token[in_prefix], m, left, right)
    a, b = n[left][:, None], n[right][None, :]
    need = -(-like.percent * (a + b) // (100 + like.percent))
    candidate = (common > 0) & (np.minimum(a, b) * 100 >= like.percent * np.maximum(a, b))
    if low == high:
        candidate = np.triu(candidate, 1)
    around, bounds = list_parts(group["regions"].combine_chunks())
    smaller = around < group["region"][0].as_py()
    if smaller.any():
        candidate &= overlaps(np.repeat(np.arange(m), np.diff(bounds))[smaller], around[smaller], m, left, right) == 0
    # Positional: after the earlier of the two last prefix shingles only one set's rest can still match.
    last, rest = token[offsets[:-1] + prefix - 1].astype(np.int32), n - prefix
    still = np.where(last[left][:, None] <= last[right][None, :], rest[left][:, None], rest[right][None, :])
    candidate &= common + still >= need
    i, j = np.nonzero(candidate)
    if not len(i):
        return node[:0], node[:0]
    rows, i_place = np.unique(i, return_inverse=True)
    columns, j_place = np.unique(j, return_inverse=True)
    equal = overlaps(doc, token, m, left[rows], right[columns])
    linked = verified(node[left[i]], node[right[j]], equal[i_place, j_place], need[i, j])
    return stars(node, left[i[linked]], right[j[linked]])


def verified(a: np.ndarray, b: np.ndarray, common: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the pairs of nodes ``(a, b)`` have as many shingles in common as a link needs."""
    return common >= need


def overlaps(doc: np.ndarray, token: np.ndarray, m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``left`` with ``right`` sets, as products of 0/1 matrices, some columns at a time."""
    sought = np.zeros(m, dtype=bool)
    sought[left], sought[right] = True, True
    doc, token = doc[sought[doc]], token[sought[doc]]
    used, token = np.unique(token, return_inverse=True)
    shared = np.bincount(token, minlength=len(used)) > 1
    column = np.cumsum(shared) - 1
    mine = shared[token]
    doc, token = doc[mine], column[token[mine]]
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        x, y = np.searchsorted(token, [a, a + COLUMNS])
        part = np.zeros((m, min(COLUMNS, int(shared.sum()) - a)), dtype=np.float32)
        part[doc[x:y], token[x:y] - a] = 1
        total += part[left] @ part[right].T
    return total


def stars(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each linked node to the first of its component."""
    label = np.arange(len(node))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    (moved,) = np.nonzero(label != np.arange(len(node)))
    return node[moved], node[label[moved]]
