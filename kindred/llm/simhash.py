"""Near-duplicates by SimHash: fingerprints that differ in few bits, met in BK-trees.

Two fingerprints that differ in at most RADIUS bits are equal in one of RADIUS + 1 blocks of their bits, so
each fingerprint goes to one shard per block (its value there) and every link lies inside a
shard. A shard is a BK-tree: children hang at their Hamming distance from the parent, and a
probe follows only the edges within the radius of its own distance. Trees have a bounded
size; each is sent to the tasks that probe it, not to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kindred.llm.components import components
from kindred.llm.stores import stored
from kindred.llm.words import NO_ID, bytes_of, doc_key, slices

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a tree, about; larger shards are cut into parts that meet part by part.
TREE = 4096
#: Rows that a task works on at once, about.
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of the word shingles of UTF-8 bytes; 0 without words. ``bytes.lower`` changes A-Z only."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # 1 MB of bits at a time
        part = h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        prints = np.array([fingerprint(t) for t in bytes_of(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64)), *b.columns[2:]], ["doc", "fingerprint", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) -> doc (long, null as NO_ID), fingerprint (long) and, if any, ``carried``: a struct of further columns."""
    rows = docs.select(doc_key(F.col("doc_id")).alias("doc"), F.col("text").alias("text"), *[F.struct(*carry).alias("carried")][:len(carry)])
    schema = "".join(f", carried {f.dataType.simpleString()}" for f in rows.schema if f.name == "carried")
    return rows.mapInArrow(_fingerprints, "doc long, fingerprint long" + schema)


def tree_edges(points: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over distinct points, all at once: ``root[i]`` is the index of the first point of i's tree.

    Returns sorted keys (parent * 65 + distance) and the child at each. Points sink level by
    level; the first to arrive at an edge becomes its child.
    """
    at, here = np.flatnonzero(root != np.arange(len(points))), None
    here = root[at]
    keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        edge = here * 65 + np.bitwise_count(points[at] ^ points[here])
        new, first, which = np.unique(edge, return_index=True, return_inverse=True)
        child = at[first]
        keys.append(new)
        children.append(child)
        here = child[which]
        stays = here != at
        at, here = at[stays], here[stays]
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys)
    return keys[order], children[order]


def probe(points: np.ndarray, keys: np.ndarray, children: np.ndarray, queries: np.ndarray, start: np.ndarray,
          radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) indices within the radius, in pieces; ``start``: root of the tree that each query probes."""
    q, node = np.arange(len(queries)), start
    while len(q):
        d = np.bitwise_count(queries[q] ^ points[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield q[hit], node[hit]
        next_q, next_node = [], []
        if not len(keys):
            return
        for step in range(-radius, radius + 1):
            edge = node * 65 + d + step
            at = np.minimum(np.searchsorted(keys, edge), len(keys) - 1)
            there = (keys[at] == edge) & (d + step >= 1)
            next_q.append(q[there])
            next_node.append(children[at[there]])
        q, node = np.concatenate(next_q), np.concatenate(next_node)


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the sets of a[i] and b[i]; ``parent`` points straight to each set's smallest index, before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def cell_links(cell: np.ndarray, probing: np.ndarray, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the points which links inside their cell connect: at most one per point.

    ``cell``: ascending ids; ``probing``: whether a point only probes the tree of the others of its cell (else it is in
    the tree and probes it too, unless some only probe). Inside a cell points are distinct.
    """
    n = len(points)
    new = np.concatenate(([True], cell[1:] != cell[:-1]))
    number = np.cumsum(new) - 1
    mixed = np.zeros(number[-1] + 1, bool)
    mixed[number[probing]] = True
    inside = np.flatnonzero(~probing)
    first = np.full(number[-1] + 1, -1, np.int64)
    first[number[inside][::-1]] = np.arange(len(inside))[::-1]
    keys, children = tree_edges(points[inside], first[number[inside]])
    asks = np.flatnonzero((probing | ~mixed[number]) & (first[number] >= 0))
    parent = np.arange(n)
    largest = int(np.bincount(number).max())
    width = max(64, 1_000_000 // largest)
    for i in range(0, len(asks), width):
        some = asks[i:i + width]
        for q, node in probe(points[inside], keys, children, points[some], first[number[some]], radius):
            parent = join_sets(parent, some[q], inside[node])
    linked = np.flatnonzero(parent != np.arange(n))
    return linked, parent[linked]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cell_hi, cell_lo, probing, fingerprint) in the order of their cells."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))
        points = rows[:, 3].copy().view(np.uint64)
        a, b = cell_links(np.cumsum(new), rows[:, 2] > 0, points)
        points = points.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(points[a]), pa.array(points[b])], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
        if not len(rows):
            continue
        held.append(rows)
        if sum(map(len, held)) >= CHUNK:
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
            if len(cut):
                yield out(rows[:cut[-1] + 1])
                held = [rows[cut[-1] + 1:]]
            else:
                held = [rows]
    if held:
        yield out(np.concatenate(held))


def links(prints: DataFrame, tree: int = TREE) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints within RADIUS bits of each other, transitively.

    No edge joins what no chain of links joins, and no link is lost; but a shard gives at most one edge per
    member, not all its pairs. Shards of more than ``tree`` members are cut by hash; every part then meets every other in
    a cell of its own, so no task holds more than two parts.
    """
    width = 64 // (RADIUS + 1) + 1
    cuts = [round(64 * i / (RADIUS + 1)) for i in range(RADIUS + 2)]
    f = F.col("fingerprint")
    values = [F.shiftrightunsigned(F.shiftleft(f, 64 - hi), 64 - hi + lo).bitwiseOR(F.lit(j << width)) for j, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    member = prints.select("fingerprint", F.explode(F.array(*values)).alias("shard"))
    shared = member.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree).cast("int")
    dealt = (member.join(shared, "shard").withColumn("parts", parts)
             .withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cells = dealt.select("shard", (low.cast("long") * (1 << 31) + high).alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("probing"), "fingerprint")
    return cells.repartition("shard", "pair").sortWithinPartitions("shard", "pair").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, fingerprint (long), component_id, component and the carried columns: one row per row.

    Documents link where their fingerprints differ in at most RADIUS bits; component_id is the smallest doc_id
    that links lead to, component the smallest fingerprint there, never null. A null or empty text has fingerprint 0 and links like any other. Equal
    texts share a fingerprint, so copies are one node of the graph, however many. A null doc_id sorts
    last; a component of such documents alone has a null id. Repeated rows stay repeated; an empty
    table gives an empty one; further columns are ignored. Texts are read once and never shuffled.
    """
    own = stored(fingerprints(docs, carry), "simhash")
    nodes = stored(own.groupBy("fingerprint").agg(F.min("doc").alias("first")), "simhash-nodes")
    member = components(links(nodes.select("fingerprint")))
    grouped = nodes.join(member.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    ids = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = grouped.join(ids, "component").select("fingerprint", "component_id", "component")
    out = own.join(answer, "fingerprint")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "fingerprint", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"), "component", *[f"carried.{c}" for c in carry])
