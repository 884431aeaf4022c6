"""A stored index of vectors by cell: nearest neighbours that look into few cells and know when to stop.

Building: centres are fitted on a bounded sample, every vector is written once, under the folder of its nearest centre. Searching:
a query looks into its nearest cells, which gives it a k-th score to beat, then into the cells that promise most, then into all others that
promise more than its k-th score by then.

What a cell promises: a vector at angle t to the centre, of which the query is alpha away, scores cos(t) cos(alpha) +
sin(t) sin(alpha) x, where x <= 1 says how far both lie on the same side of the centre. The promise is the largest such score over the angles t
that the cell's vectors have, with x up to ``lean``. With lean = 1 nothing can be missed. In many dimensions vectors hardly lean to one side, and
a smaller lean leaves most cells out: which one keeps a wanted share of neighbours is measured when the index is built, against brute force
for a bounded number of made-up queries.

Nothing stored is shuffled by a search: tasks read the folders that any query of a block asks for, with the block at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.vectors import norm
from kindred.operators.lineage import durable, scratch_dir
from kindred.operators.ranking import top_k

#: Cells at most, so that the centres fit into every task; vectors of the sample per cell, and its bytes at most.
MOST_CELLS, PER_CELL, SAMPLE_BYTES = 1 << 14, 64, 64 << 20
#: Bytes of query vectors that are broadcast at once, and scores that a task holds at once.
QUERY_BYTES, SCORES = 64 << 20, 4_000_000
#: Rows of an answer that a task holds before it cuts them to the best, if the queries of a block have no more.
HELD = 500_000
#: Parts of a degree in which the distances to the centre are counted.
STEPS = 10
#: Cells that a query asks in the first turn and in the second.
TURNS = (8, 64)
#: Queries and neighbours of each by which the lean is measured.
TRIALS, NEIGHBOURS = 256, 10
RECALL = 0.95


def cells_for(n: int) -> int:
    """Cells for ``n`` vectors: the power of two next to the square root, 4,096 for ten million."""
    return int(min(MOST_CELLS, 2 ** max(0, round(np.log2(max(1, n)) / 2))))


def units(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def pieces(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows with at most SCORES numbers of ``width`` a row."""
    step = max(1, SCORES // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0))


def fit_centres(embeddings: DataFrame, cells: int, per_cell: int = PER_CELL, sample_bytes: int = SAMPLE_BYTES, seed: int = 7) -> np.ndarray:
    """Centres of at most ``cells`` cells, by k-means with cosines on a sample.

    The sample is drawn by the hash of the ids: about ``per_cell`` vectors a cell, ``sample_bytes`` at most.
    """
    n, width = embeddings.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return np.zeros((0, 0))
    wanted = max(1, min(cells * per_cell, sample_bytes // (8 * width)))
    drawn = embeddings.where(F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(1_000_000)) < 1_000_000 * wanted // n) if wanted < n else embeddings
    points = drawn.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if cells == 1:
        return np.eye(1, width)
    model = KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=8, seed=seed).fit(points)
    return units(pd.Series([np.asarray(c) for c in model.clusterCenters()]))


def _assigner(shared):
    @F.pandas_udf("cell int, angle float")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for vectors in batches:
            if vectors.empty:
                yield pd.DataFrame({"cell": [], "angle": []})
                continue
            m, cell, best = units(vectors), [], []
            for s in pieces(len(m), len(centres)):
                cosines = m[s] @ centres.T
                cell.append(cosines.argmax(1))
                best.append(cosines.max(1))
            yield pd.DataFrame({"cell": np.concatenate(cell), "angle": angles(np.concatenate(best))})

    return assign


def promise(cosines: np.ndarray, near: np.ndarray, far: np.ndarray, lean: float) -> np.ndarray:
    """The best score that cells (columns, with vectors ``near`` to ``far`` from the centre) can have for queries by their cosines to the centre."""
    a, b = cosines, lean * np.sqrt(np.maximum(0, 1 - cosines**2))
    t = np.clip(np.arctan2(b, a), near, far)  # a cos(t) + b sin(t) is largest there
    return np.where(far < 0, -2.0, np.minimum(1, a * np.cos(t) + b * np.sin(t)))


class Block:
    """Some queries as tasks see them in one turn: unit vectors, the cells each has asked or asks by number, and the score to beat."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, asked: np.ndarray, now: np.ndarray, beat: np.ndarray | None, lean: float):
        """``asked``, ``now``: a row of cells per query, -1 for none; with empty ``now`` the turn is for all cells that promise enough."""
        self.ids, self.units, self.beat, self.lean = ids, units, beat, lean
        self.rest = not now.size
        cells = asked if self.rest else now
        flat = cells.ravel()
        order = np.argsort(flat, kind="stable")
        self.cell, self.query = flat[order].astype(np.int32), (order // max(1, cells.shape[1])).astype(np.int32)

    def visits(self, cell: int, centre: np.ndarray, near: float, far: float) -> np.ndarray:
        """Which queries look into a cell in this turn."""
        named = self.query[slice(*np.searchsorted(self.cell, [cell, cell + 1]))]
        if not self.rest:
            return named
        good = promise(self.units @ centre, np.float64(near), np.float64(far), self.lean) >= self.beat - 1e-9
        good[named] = False
        return np.flatnonzero(good)


def top_cells(scores: np.ndarray, k: int, min_score: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best ``k`` scores per row; ties go to the lower column."""
    scores[np.isnan(scores)] = -np.inf
    keep = (scores >= min_score) & (scores > -np.inf)
    if scores.shape[1] <= k:
        return np.nonzero(keep)
    cut = np.partition(scores, -k, axis=1)[:, [-k]]
    row, col = np.nonzero(keep & (scores >= cut))
    level = scores[row, col] == cut[row, 0]
    room, tied = k - np.bincount(row[~level], minlength=len(scores)), row[level]
    take = ~level
    take[level] = np.arange(len(tied)) - np.searchsorted(tied, tied) < room[tied]
    return row[take], col[take]


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["score", "record_id"], ascending=[False, True], kind="stable").groupby("query_id", sort=False).head(k)


def _scanner(shared, k: int, scored):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, centres, near, far = shared.value
        found, held, known = [], 0, {}
        most = max(HELD, 2 * k * len(block.ids))
        for batch in batches:
            for cell, rows in batch.groupby("cell", sort=False):
                if cell not in known:
                    known[cell] = block.visits(cell, centres[cell], near[cell], far[cell])
                asking = known[cell]
                if not len(asking):
                    continue
                rows = rows.sort_values("record_id", kind="stable")
                ids, m = rows["record_id"].to_numpy(), units(rows["vector"])
                scored.add(len(asking) * len(ids))
                for s in pieces(len(asking), len(ids)):
                    some = asking[s]
                    scores = np.round(block.units[some] @ m.T, 10)
                    # k per query, however many vectors are equal
                    q, e = top_cells(scores, k, -2.0 if block.beat is None else block.beat[some][:, None] - 1e-9)
                    found.append(pd.DataFrame({"query_id": block.ids[some[q]], "record_id": ids[e], "score": scores[q, e]}))
                    held += len(q)
                    if held > most:
                        found = [_first(pd.concat(found), k)]
                        held = len(found[0])
        if found:
            yield _first(pd.concat(found), k)

    return scan


class VectorIndex:
    """The index stored under ``path``: centres, vectors in folders ``cell=...``, counts of their distances to the centres, leans measured."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
        self.centres = np.array([r["centre"] for r in rows])
        #: Pairs of a query and a stored vector that searches have scored so far, about (tasks that run again count again).
        self.scored = spark.sparkContext.accumulator(0)

    @classmethod
    def build(cls, embeddings: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Index ``embeddings`` (record_id, embedding); null and zero vectors have no cosine and stay out."""
        spark = embeddings.sparkSession
        some = _usable(embeddings.select("record_id", "embedding"), "embedding")
        centres = fit_centres(some, cells or cells_for(some.count()), seed=seed)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path.rstrip('/')}/centres")
        index = cls(spark, path)
        index.add(some)
        index.measure(seed)
        return index

    def add(self, embeddings: DataFrame) -> None:
        """Write further vectors into their cells. Payload is shuffled once, and large cells go to several tasks (``REBALANCE``)."""
        shared = self.spark.sparkContext.broadcast(self.centres)  # at most MOST_CELLS centres
        some = _usable(embeddings.select("record_id", F.col("embedding").alias("vector")), "vector")
        if not len(self.centres):
            if some.isEmpty():
                return
            raise ValueError("this index was built of no vectors: build a new one")
        batch = scratch_dir(self.spark, "batch").rsplit("-", 1)[1]
        placed = some.withColumn("place", _assigner(shared)(F.col("vector"))).select("record_id", "vector", "place.cell", "place.angle", F.lit(batch).alias("batch"))
        placed.hint("rebalance", "cell").write.partitionBy("cell").mode("append").parquet(f"{self.path}/vectors")
        new = self.vectors().where(F.col("batch") == batch)
        step = F.floor(F.degrees("angle") * STEPS).cast("int").alias("step")
        new.groupBy("cell", step).agg(F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{self.path}/angles")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("record_id string, vector array<float>, angle float, batch string, cell int").parquet(f"{self.path}/vectors")

    def shells(self) -> tuple[np.ndarray, np.ndarray]:
        """Per cell the smallest and the largest angle of its vectors to the centre, rounded outwards; -10 for empty cells."""
        near, far = np.full(len(self.centres), -10.0), np.full(len(self.centres), -10.0)
        for r in self.spark.read.parquet(f"{self.path}/angles").groupBy("cell").agg(F.min("step").alias("a"), F.max("step").alias("b")).collect():  # a row per cell
            near[r["cell"]], far[r["cell"]] = np.radians(r["a"] / STEPS - 1e-4), np.radians((r["b"] + 1) / STEPS + 1e-4)
        return near, far

    def measure(self, seed: int = 7, trials: int = TRIALS) -> None:
        """Store which lean keeps which share of the true neighbours, measured with about ``trials`` queries by brute force.

        The queries lie between two stored vectors each (x + 0.4 y), so they are none themselves.
        """
        path = f"{self.path}/leans"
        n = self.vectors().count() if len(self.centres) else 0
        needed = np.zeros(0)
        if n:
            some = self.vectors().where(F.pmod(F.xxhash64("record_id", F.lit(seed + 1)), F.lit(1_000_000)) < max(1, 2_000_000 * trials // n)) if n > 2 * trials else self.vectors()
            drawn = units(some.select("record_id", "vector").orderBy("record_id").toPandas()["vector"])  # about 2 x trials
            half = max(1, len(drawn) // 2)
            m = drawn[:half] + 0.4 * drawn[-half:]
            m = m / np.maximum(1e-12, np.linalg.norm(m, axis=1, keepdims=True))
            near, far = self.shells()
            block = Block(np.arange(half), m, np.zeros((half, 0), np.int64), np.zeros((half, 0), np.int64), np.full(half, -2.0), 1.0)
            found = self._scan(block, np.arange(len(self.centres)), NEIGHBOURS, near, far, "query_id long, record_id string, score double")
            hits = found.join(self.vectors().select("record_id", "cell"), "record_id").toPandas()  # trials x NEIGHBOURS
            cosines = m @ self.centres.T
            cosines[:, far < 0] = -2
            rank = (-cosines).argsort(1).argsort(1)
            q, cell = hits["query_id"].to_numpy(), hits["cell"].to_numpy()
            kth = hits.groupby("query_id")["score"].min().reindex(range(half)).to_numpy()[q]
            low, high = np.zeros(len(q)), np.ones(len(q))
            for _ in range(30):
                mid = (low + high) / 2
                enough = promise(cosines[q, cell], near[cell], far[cell], mid) >= kth - 1e-9
                low, high = np.where(enough, low, mid), np.where(enough, mid, high)
            needed = np.sort(np.where(rank[q, cell] < TURNS[0], 0, high))
        share = (np.arange(len(needed)) + 1) / max(1, len(needed))
        rows = [(float(s), float(x)) for s, x in zip(share, needed, strict=True)]
        self.spark.createDataFrame(rows, "share double, lean double").coalesce(1).write.mode("overwrite").parquet(path)

    def lean(self, recall: float) -> float:
        """The smallest measured lean that keeps ``recall`` of the neighbours; 1 for all of them."""
        if recall >= 1:
            return 1.0
        row = self.spark.read.parquet(f"{self.path}/leans").where(F.col("share") >= recall).agg(F.min("lean")).first()
        return 1.0 if row[0] is None else row[0]

    def search(self, query_vectors: DataFrame, k: int = 5, recall: float = RECALL, query_bytes: int = QUERY_BYTES) -> DataFrame:
        """(query_id, record_id, score, rank): the ``k`` nearest by cosine, ties by id.

        ``recall``: the share of true neighbours to find, as measured with the index's own trials; with 1 the answer is exact. Each
        block of queries (``query_bytes`` of vectors, broadcast) reads the folders it asks for in three turns. Queries without a
        usable vector have no rows.
        """
        kind = query_vectors.schema["query_id"].dataType.simpleString()
        schema = f"query_id {kind}, record_id string, score double"
        asked = _usable(query_vectors.select("query_id", F.col("query_vector").alias("vector")), "vector")
        n, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
        out = self.spark.createDataFrame([], schema)
        blocks = -(-n * (width or 0) * 8 // query_bytes) if len(self.centres) else 0
        lean = self.lean(recall) if blocks else 1.0
        for b in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()  # about query_bytes
            if len(own):
                out = out.union(self._block(own, k, lean, schema))
        return top_k(out, ["query_id"], [F.col("score").desc(), F.col("record_id")], k, rank="rank")

    def _block(self, own: pd.DataFrame, k: int, lean: float, schema: str) -> DataFrame:
        near, far = self.shells()
        full = np.flatnonzero(far >= 0)
        ids, m = own["query_id"].to_numpy(), units(own["vector"])
        beat = np.full(len(ids), -2.0)
        asked, out = np.zeros((len(ids), 0), np.int64), None
        for width in (*TURNS, 0):
            now, rest = np.full((len(ids), min(width, len(full))), -1), np.zeros(len(full), bool)
            for s in pieces(len(m), len(full)):
                cosines = m[s] @ self.centres[full].T
                # the first turn goes by nearness, the others by promise
                value = cosines + 3 if out is None else promise(cosines, near[full], far[full], lean)
                value[(value < beat[s][:, None] - 1e-9)] = -9
                for c in range(asked.shape[1]):
                    value[np.arange(len(value)), np.searchsorted(full, asked[s][:, c])] = -9
                rest |= (value > -9).any(0)
                if now.shape[1]:
                    best = np.argpartition(-value, now.shape[1] - 1, axis=1)[:, :now.shape[1]]
                    now[s] = np.where(np.take_along_axis(value, best, 1) > -9, full[best], -1)
            cells = np.unique(now[now >= 0]) if now.size else full[rest]
            if not len(cells):
                continue
            found = self._scan(Block(ids, m, asked, now, None if out is None else beat, lean), cells, k, near, far, schema)
            out = found if out is None else durable(top_k(out.union(found), ["query_id"], [F.col("score").desc(), F.col("record_id")], k))
            # one number per query of the block
            kth = out.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).toPandas()
            beat = pd.Series(ids).map(dict(zip(kth["query_id"], kth["kth"], strict=True))).fillna(-2.0).to_numpy(float)
            asked = np.concatenate((asked, np.where(now < 0, asked[:, :1] if asked.size else now, now)), 1)
        return out

    def _scan(self, block: Block, cells: np.ndarray, k: int, near: np.ndarray, far: np.ndarray, schema: str) -> DataFrame:
        """The best ``k`` for each query among the cells of a turn; tasks give at most k rows a query."""
        shared = self.spark.sparkContext.broadcast((block, self.centres, near, far))  # query_bytes and the centres
        wanted: Column = F.col("cell").isin([int(c) for c in cells]) if len(cells) < len(self.centres) else F.lit(True)
        found = self.vectors().where(wanted).select("cell", "record_id", "vector").mapInPandas(_scanner(shared, k, self.scored), schema)
        return durable(top_k(found, ["query_id"], [F.col("score").desc(), F.col("record_id")], k))
