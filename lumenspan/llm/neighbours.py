"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts (recursive bisection,
refined by exchanging the nodes that gain most), a small classifier learns to tell a
vector's part, and routes every row to one part and every query to the few likeliest
ones. How many, is measured: the least number whose recall on the sample, against brute
force, reaches a goal; where those hold too few rows, the next likeliest follow. Candidates are reranked by the exact inner product in doubles.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_hash, materialize, sample_share

#: Bound of the sample that partitions and classifier are learnt from; all rows are indexed.
SAMPLE = 12_000
NEIGHBOURS = 12
#: Rows a part should hold, and the bounds of the number of parts.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4_000, 4, 128
HIDDEN, EPOCHS, RATE = 128, 24, 0.003
RECALL_GOAL = 0.97
#: Numbers in one block of rows or queries; a part of any size is searched block by block.
BLOCK_VALUES = 1_500_000
TOP = 20


def sound(column: str):
    """True for vectors that take part: not null or empty, all components finite numbers, not all zero."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(c, lambda x: x != 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest others by inner product, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 1024):
        s = x[low : low + 1024] @ x.T
        s[np.arange(len(s)), low + np.arange(len(s))] = -np.inf
        out[low : low + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, x: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """One side (as a mask) of a balanced cut: halves along the main direction, then exchanges of the nodes with the largest gains."""
    own = x[nodes] - x[nodes].mean(0)
    direction = np.linalg.eigh(own.T @ own)[1][:, -1]
    order = np.argsort(own @ direction, kind="stable")
    side = np.zeros(len(nodes), bool)
    side[order[len(nodes) // 2 :]] = True
    place = np.full(len(x), -1)
    place[nodes] = np.arange(len(nodes))
    a, b = place[source], place[target]
    inside = (a >= 0) & (b >= 0)
    a, b = a[inside], b[inside]

    def cut() -> int:
        return int((side[a] != side[b]).sum())

    best, kept, swap = cut(), side.copy(), max(1, len(nodes) // 20)
    while swap:
        across = (side[a] != side[b]) * 2 - 1
        gain = np.bincount(a, across, len(nodes)) + np.bincount(b, across, len(nodes))
        ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
        n = min(swap, len(ones), len(zeros))
        side[ones[np.argsort(-gain[ones], kind="stable")[:n]]] = False
        side[zeros[np.argsort(-gain[zeros], kind="stable")[:n]]] = True
        now = cut()
        if now < best:
            best, kept = now, side.copy()
        else:
            side, swap = kept.copy(), swap // 2
    return kept


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node; ``parts`` is a power of two and sizes differ by rounding only."""
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    out = np.zeros(len(x), np.int64)
    width = 1
    while width < parts:
        for p in range(width):
            nodes = np.flatnonzero(out == p)
            if len(nodes) > 1:
                out[nodes[_bisect(nodes, x, source, target)]] += width
        width *= 2
    return out


@dataclass
class Router:
    """Two-layer classifier of vectors into parts; ``probes`` parts are searched for each query."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1
    recall: float = 1.0  # of the sample's own neighbours within that many parts

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x.astype(np.float32) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, part: np.ndarray, parts: int, seed: int = 13) -> Router:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    scale = float(1 / max(1e-12, np.sqrt((x * x).sum(1).mean() / x.shape[1])))
    net = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    net = [w.astype(np.float32) for w in net]
    first, second, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for low in range(0, len(order), 128):
            pick = order[low : low + 128]
            h = np.maximum(x[pick] * scale @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), part[pick]] -= 1
            p /= len(pick)
            back = (p @ net[2].T) * (h > 0)
            step += 1
            for i, g in enumerate(((x[pick] * scale).T @ back, back.sum(0), h.T @ p, p.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-7)
    return Router(scale, *net)


def fit(x: np.ndarray, rows: int, goal: float = RECALL_GOAL, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> Router:
    """A router for ``rows`` rows from the sample ``x``; probes reach ``goal`` recall of the sample's own neighbours."""
    parts = min(LEAST_PARTS, most_parts)
    while parts < most_parts and parts * part_rows < rows and parts * 64 < len(x):
        parts *= 2
    graph = neighbour_graph(x, NEIGHBOURS) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    router = train_router(x, balanced_parts(x, graph, parts), parts)
    asked = np.arange(0, len(x), max(1, len(x) // 1500))
    home = router.scores(x).argmax(1)
    truth = neighbour_graph(x, TOP)[asked] if len(x) > TOP else np.tile(np.arange(len(x)), (len(asked), 1))
    ranked = np.argsort(-router.scores(x[asked]), axis=1)
    found = home[truth]
    for probes in range(1, parts + 1):
        hit = (found[:, :, None] == ranked[:, None, :probes]).any(2).mean()
        if hit >= goal:
            break
    router.probes, router.recall = probes, float(hit)
    return router


@dataclass
class Tree:
    """One router, or one and another for each of its parts; parts are numbered through."""

    root: Router
    children: dict[int, Router]

    @property
    def stride(self) -> int:
        return max([1, *[len(c.b2) for c in self.children.values()]])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row belongs to."""
        out = self.root.scores(x).argmax(1) * self.stride
        for p, child in self.children.items():
            own = np.flatnonzero(out == p * self.stride)
            if len(own):
                out[own] += child.scores(x[own]).argmax(1)
        return out

    def probe(self, x: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
        """The parts that each query looks into: the likeliest ones, and further ones until they hold ``need`` rows."""
        ranked = np.argsort(-self.root.scores(x), axis=1, kind="stable")
        inner = {p: np.argsort(-c.scores(x), axis=1, kind="stable") for p, c in self.children.items()}
        out = []
        for q, order in enumerate(ranked):
            first, rest = [], []
            for at, p in enumerate(order.tolist()):
                child = self.children.get(p)
                own = p * self.stride + (inner[p][q] if child else np.zeros(1, np.int64))
                cut = 0 if at >= self.root.probes else child.probes if child else 1
                first.append(own[:cut])
                rest.append(own[cut:])
            chosen, more = np.concatenate(first), np.concatenate(rest)
            short = need[q] - sizes[chosen].sum()
            if short > 0:
                chosen = np.append(chosen, more[: int(np.searchsorted(np.cumsum(sizes[more]), short)) + 1])
            out.append(chosen.astype(np.int32))
        return out


def block_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``top`` best rows, own id left out; ties to the smaller id.

    Products come from one matrix product; what may be among the best is scored again
    row by row, so equal vectors score equally wherever they lie.
    """
    out = ([], [], [])
    if not len(rows) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    slack = 1e-12 * np.sqrt((rows * rows).sum(1).max())
    for low in range(0, len(queries), 256):
        part = queries[low : low + 256]
        s = part @ rows.T
        for i, q in enumerate(part):
            line = s[i]
            own = query_ids[low + i]
            k = min(top + 1, len(line))  # one more, as the query itself may be there
            edge = np.partition(line, len(line) - k)[len(line) - k] - slack * np.sqrt(q @ q)
            at = np.flatnonzero(line >= edge)
            at = at[ids[at] != own]
            exact = (rows[at] * q).sum(1)
            order = np.lexsort((ids[at], -exact))[:top]
            out[0].append(np.full(len(order), own))
            out[1].append(ids[at[order]])
            out[2].append(exact[order])
    return tuple(np.concatenate(x) for x in out)


def _vectors(column, dim: int) -> np.ndarray:
    """A batch's list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def train_tree(usable: DataFrame, dim: int, rows: int, goal: float, part_rows: int, most_parts: int) -> Tree:
    """Routers for all ``rows`` of ``usable`` (id, v), from bounded samples: SAMPLE rows at the root, and SAMPLE rows of each of its parts where one level isn't enough."""
    deep = rows > most_parts * part_rows
    goal = goal**0.5 if deep else goal
    sample = usable.where(by_hash(sample_share(SAMPLE, rows), "id")).orderBy("id").select("v").toPandas()["v"]
    root = fit(np.array(sample.tolist(), np.float64).reshape(-1, dim), rows, goal, part_rows, most_parts)
    if not deep:
        return Tree(root, {})
    spark = usable.sparkSession
    shared = spark.sparkContext.broadcast(Tree(root, {}))

    def place(batches):
        for batch in batches:
            home = shared.value.home(_vectors(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array(home, pa.int32())], names=["id", "v", "part"])

    placed = materialize(usable.select("id", "v").mapInArrow(place, "id long, v array<double>, part int"), "placed")
    held = placed.groupBy("part").count()  # at most MOST_PARTS rows
    there = {r["part"]: r["count"] for r in held.collect()}
    share = F.lit(0.0)
    for part, n in there.items():
        share = F.when(F.col("part") == part, sample_share(SAMPLE, n)).otherwise(share)

    def learn(own: pa.Table) -> pa.Table:
        own = own.sort_by("id")
        part = own.column("part")[0].as_py()
        child = fit(_vectors(own.column("v"), dim), there[part], goal, part_rows, most_parts)
        return pa.table({"part": pa.array([part], pa.int32()), "router": pa.array([pickle.dumps(child)], pa.binary())})

    found = placed.where(by_hash(share, "id", 11)).groupBy("part").applyInArrow(learn, "part int, router binary").collect()
    return Tree(root, {r["part"]: pickle.loads(r["router"]) for r in found})


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, tree: Tree | None = None, goal: float = RECALL_GOAL, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies ``is_query``, its nearest other rows by inner product.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor
    do rows without id or with another dimension than most. Rows that repeat an id are
    one candidate each and never meet a query of that id. Fewer candidates than ``top``
    give fewer rows, an empty table none. Other columns are ignored.
    """
    usable = vectors.where(F.col(id_col).isNotNull() & sound(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = sizes
    usable = usable.where(F.size("v") == dim)
    if tree is None:
        tree = train_tree(usable, dim, count, goal, part_rows, most_parts)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    parts = len(tree.root.b2) * tree.stride
    block = max(256, BLOCK_VALUES // dim)

    def route(batches):
        for batch in batches:
            home = shared.value.home(_vectors(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), batch.column(2), pa.array(home, pa.int32())], names=["id", "v", "asks", "part"])

    routed = materialize(usable.select("id", "v", "asks").mapInArrow(route, "id long, v array<double>, asks boolean, part int"), "routed")
    held = routed.groupBy("part").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    there = np.zeros(parts, np.int64)
    for r in held.collect():  # a row a part
        there[r["part"]] = r["n"]
    # Rows that repeat a query's id are none of its neighbours.
    again = routed.groupBy("id").count().where("count > 1")
    asking = routed.where("asks").join(again, "id", "left").select("id", "v", (F.lit(top) + F.coalesce("count", F.lit(1))).alias("need"))

    def ask(batches):
        for batch in batches:
            found = shared.value.probe(_vectors(batch.column(1), dim), there, batch.column(2).to_numpy())
            ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "v", "parts"])

    asking = materialize(asking.mapInArrow(ask, "id long, v array<double>, parts array<int>"), "asking")
    asked = asking.select(F.explode("parts").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("rounds"))
    grid = F.broadcast(held.join(asked, "part"))  # a row a part: at most the square of MOST_PARTS

    def spread(n, seed, key="id"):
        return F.pmod(F.xxhash64(key, F.lit(seed)), n).cast("int")

    rows = routed.select("id", "v", "part").join(grid, "part").withColumn("block", spread(F.col("blocks"), 1)).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    asks = asking.select(F.col("id").alias("asker"), F.col("v").alias("asked"), F.explode("parts").alias("part")).join(grid, "part").withColumn("round", spread(F.col("rounds"), 2, "asker")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left_cell, cell = [F.col(c).alias(f"asked_{c}") for c in ("part", "round", "block")], ["part", "round", "block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r, s = block_search(left.column(0).to_numpy(), _vectors(left.column(1), dim), right.column(0).to_numpy(), _vectors(right.column(1), dim), top)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()), "score": pa.array(s, pa.float64())})

    met = asks.select("asker", "asked", *left_cell).groupBy(*[f"asked_{c}" for c in cell]).cogroup(rows.select("id", "v", *cell).groupBy(*cell)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
