"""Exact top-k inner-product search over M-trees, best first.

Vectors are padded with one coordinate that gives all of a tree the same length; then the
largest inner product is the smallest distance, and a metric tree can answer. A tree is
a few arrays of pages: each entry has its routing vector, its covering radius and its distance
to the routing vector of the page above. A search keeps pages in a queue by the
smallest distance they can hold; within a page, entries whose stored distance to the parent
already shows them too far (|d(q, parent) - d(entry, parent)| - radius > bound) are never
computed. Bounds carry a slack against rounding, and scores are exact integers.

The trees hang below a top level of pivots, rows picked by a seeded hash: every row belongs to the cell of its nearest pivot, and a cell of
more than TREE rows is cut into several trees by hash, so that a thousand copies of one vector spread like any others. A query first
searches its own cell. The k-th score found there goes with it to the other cells, and only to those whose ball (pivot and radius)
can hold a score as high; the bound also starts its search in each tree. The k best of all are merged by (score, smaller id).
There are at most PIVOTS pivots (a few megabytes, which go with the code), and queries go to a tree in blocks of about QUERIES.

Defined results: vectors that are null, or hold a null or a component that is not finite,
take no part; shorter vectors count as padded with zeros; rows that repeat another in id
and vector take part once; an id with several vectors is one query whose searches are ranked together, each hit on its own; a null
id takes no part; ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TREE, QUERIES, PAGE, FANOUT, PIVOTS = 8192, 8192, 512, 16, 4096
#: Below every score.
LEAST = -(2**62)


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double before rounding; null for vectors that take no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & whole, F.transform(x, lambda v: F.floor(v * scale)))


class MTree:
    """Arrays of a bulk-loaded M-tree over integer vectors `x` with ids `ids`; the rows of a leaf stand together."""

    FIELDS = ("ids", "x", "lift", "first", "count", "leaf", "entry", "radius", "above", "child", "root")

    def __init__(self, **arrays):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])
        self.norm = (self.x[:1].astype(float) ** 2).sum() + self.lift[0] ** 2 if len(self.ids) else 0.0
        self.f = self.x.astype(float)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, seed: int = 5) -> MTree:
        f = x.astype(float)
        squares = (f**2).sum(axis=1)
        lift = np.sqrt(squares.max(initial=0.0) - squares)
        full = np.hstack([f, lift[:, None]])
        rng = np.random.default_rng(seed)
        first, count, leaf, entry, radius, above, child = [], [], [], [], [], [], []

        def distances(rows, to):
            return np.sqrt(((full[rows] - full[to]) ** 2).sum(axis=1))

        def page(rows: np.ndarray, parent: int) -> tuple[int, float]:
            """Page over rows below the routing row `parent`; its number and covering radius."""
            d = distances(rows, parent)
            if len(rows) <= PAGE:
                groups = None
            else:
                pivots = rng.choice(rows, min(FANOUT, -(-len(rows) // PAGE)), replace=False)
                near = np.stack([distances(rows, p) for p in pivots]).argmin(axis=0)
                groups = [(int(p), rows[near == k]) for k, p in enumerate(pivots) if (near == k).any()]
                if max(len(g) for _, g in groups) > 0.9 * len(rows):  # nearly all alike: halve by count instead
                    groups = [(int(g[0]), g) for g in np.array_split(rows[np.argsort(d, kind="stable")], FANOUT)]
            if groups is None:
                below = [(int(r), -1, 0.0) for r in rows]
            else:
                below = [(p, *page(g, p)) for p, g in groups]
            first.append(len(entry))
            count.append(len(below))
            leaf.append(groups is None)
            entry.extend(e for e, _, _ in below)
            child.extend(c for _, c, _ in below)
            radius.extend(r for _, _, r in below)
            above.extend(distances(np.array([e for e, _, _ in below]), parent).tolist())
            return len(first) - 1, float(d.max())

        if len(ids):
            page(np.arange(len(ids)), 0)
        entry, child = np.array(entry, int), np.array(child, int)
        order, place = entry[child < 0], np.zeros(len(ids), int)
        place[order] = np.arange(len(ids))
        return cls(
            ids=ids[order], x=x[order], lift=lift[order], first=np.array(first, int), count=np.array(count, int), leaf=np.array(leaf, bool),
            entry=place[entry], radius=np.array(radius), above=np.array(above), child=child, root=place[:1],
        )

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> MTree:
        with np.load(io.BytesIO(blob)) as d:
            return cls(**{k: d[k] for k in cls.FIELDS})

    def search(self, q: np.ndarray, k: int, skip: int | None = None, floor: int = LEAST) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) with a score of `floor` or more, but for the id `skip`, and how many distances were computed."""
        if not len(self.ids):
            return [], 0
        qf = q.astype(float)
        square = float(qf @ qf) + self.norm
        slack = 1e-6 * (1 + square) ** 0.5

        def distance(inner: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square - 2 * inner, 0))

        best: list[tuple[int, int, int]] = []  # heap of (score, -id, id): the worst is on top
        bound = np.inf if floor == LEAST else max(square - 2 * floor, 0) ** 0.5
        queue = [(0.0, len(self.first) - 1, float(distance(self.f[self.root] @ qf)[0]))]
        computed = 1
        while queue:
            least, node, to_parent = heapq.heappop(queue)
            if least > bound + slack:
                break
            s = slice(self.first[node], self.first[node] + self.count[node])
            near = np.flatnonzero(np.abs(to_parent - self.above[s]) - self.radius[s] <= bound + slack)
            rows = self.entry[s]
            if self.leaf[node] and len(near) == len(rows):
                d = distance(self.f[rows[0] : rows[0] + len(rows)] @ qf)
            else:
                rows = rows[near]
                d = distance(self.f[rows] @ qf)
            computed += len(rows)
            if self.leaf[node]:
                for i in np.flatnonzero(d <= bound + slack).tolist():
                    ident = int(self.ids[rows[i]])
                    if ident == skip:
                        continue
                    item = (int(self.x[rows[i]] @ q), -ident, ident)
                    if item[0] < floor:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    bound = min(bound, max(square - 2 * best[0][0], 0) ** 0.5)
            else:
                for c, far, r in zip(self.child[s][near].tolist(), d.tolist(), self.radius[s][near].tolist()):
                    if far - r <= bound + slack:
                        heapq.heappush(queue, (max(far - r, 0.0), c, far))
        return [(s, i) for s, _, i in sorted(best, key=lambda t: (-t[0], t[2]))], computed


def _square(vectors: list[list[int]]) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    return np.array([v + [0] * (width - len(v)) for v in vectors], dtype=np.int64).reshape(len(vectors), width)


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.hstack([a, np.zeros((len(a), width - a.shape[1]), a.dtype)]) if a.shape[1] < width else a


def vectors_of(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and q, the integer vector, of the rows that take part; exact repeats once."""
    found = rows.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding), scale).alias("q"))
    return found.filter(F.col("q").isNotNull() & F.col("vec_id").isNotNull()).distinct()


class Top:
    """The pivots of the forest and, once the rows are counted, the radius and the number of trees of each one's cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(float)
        self.radius, self.parts = np.zeros(len(pivots)), np.zeros(len(pivots), int)

    @classmethod
    def pick(cls, vectors: DataFrame, trees: int) -> Top:
        """At most PIVOTS rows with the smallest seeded hashes, equal ones once."""
        rows = vectors.select("q").orderBy(F.xxhash64(F.lit(23), "vec_id", "q")).limit(min(trees, PIVOTS)).collect()
        return cls(np.unique(_square([r["q"] for r in rows]), axis=0) if rows else np.zeros((1, 0)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the cell it belongs to and how far its pivot is."""
        width = max(x.shape[1], self.pivots.shape[1])
        x, p = _widen(x, width).astype(float), _widen(self.pivots, width)
        square, cell, gap = (p**2).sum(axis=1), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            cell[i : i + 1024] = (square[None, :] - 2 * part @ p.T).argmin(axis=1)
            gap[i : i + 1024] = np.sqrt(((part - p[cell[i : i + 1024]]) ** 2).sum(axis=1))
        return cell, gap

    def may_hold(self, x: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Queries by cells: whether the cell's ball can hold a score of `floor` or more."""
        width = max(x.shape[1], self.pivots.shape[1])
        x, p = _widen(x, width).astype(float), _widen(self.pivots, width)
        most = x @ p.T + np.sqrt((x**2).sum(axis=1))[:, None] * self.radius[None, :]
        return (most * (1 + 1e-9 * np.sign(most)) + 1 >= floor[:, None]) & (self.parts > 0)[None, :]


def _placed(vectors: DataFrame, top: Top) -> DataFrame:
    """vec_id, q, cell and gap, the distance to the cell's pivot."""

    def rows(batches):
        for b in batches:
            cell, gap = top.nearest(_square(b.column("q").to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(gap)], names=["vec_id", "q", "cell", "gap"])

    return vectors.select("vec_id", "q").mapInArrow(rows, "vec_id long, q array<long>, cell long, gap double")


def index(placed: DataFrame, top: Top) -> DataFrame:
    """cell, part, blob: an M-tree over each share of a cell's vectors."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        tree = MTree.build(t.column("vec_id").to_numpy(), _square(t.column("q").to_pylist()))
        return pa.table({"cell": t.column("cell").slice(0, 1), "part": t.column("part").slice(0, 1), "blob": pa.array([tree.dumps()], pa.binary())})

    parts = placed.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(top.parts.tolist())], "cell long, parts long")
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.col("parts")))  # at most PIVOTS rows
    return dealt.select("cell", "part", "vec_id", "q").groupBy("cell", "part").applyInArrow(build, "cell long, part long, blob binary")


def _routed(queries: DataFrame, top: Top, blocks: int, own: bool) -> DataFrame:
    """cell, part, block and queries, packed: each query (vec_id, q, cell, floor) for its own cell, or for all others that can hold a score as high as its floor."""

    def rows(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids, x = part.column("vec_id").to_numpy(), _square(part.column("q").to_pylist())
                cell, floor = part.column("cell").to_numpy(), part.column("floor").to_numpy()
                mine = cell[:, None] == np.arange(len(top.parts))[None, :]
                goes = mine if own else top.may_hold(x, floor.astype(float)) & ~mine
                block, out = ids.astype(np.uint64) % np.uint64(blocks), []
                for c in np.flatnonzero(goes.any(axis=0)).tolist():
                    for k in np.unique(block[goes[:, c]]).tolist():
                        r = np.flatnonzero(goes[:, c] & (block == k))
                        held = io.BytesIO()
                        np.savez(held, ids=ids[r], x=x[r], floor=floor[r])
                        out += [(c, p, int(k), held.getvalue()) for p in range(int(top.parts[c]))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["cell", "part", "block", "queries"])

    return queries.select("vec_id", "q", "cell", "floor").mapInArrow(rows, "cell long, part long, block long, queries binary")


def _answers(forest: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each tree for each query that came to it."""

    def answer(trees: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if trees.num_rows and asked.num_rows:
            tree = MTree.loads(trees.column("blob")[0].as_py())
            for blob in asked.column("queries").to_pylist():
                with np.load(io.BytesIO(blob)) as d:
                    ids, x, floor = d["ids"], d["x"], d["floor"]
                width = max(tree.x.shape[1], x.shape[1])
                x, tree.x, tree.f = _widen(x, width), _widen(tree.x, width), _widen(tree.f, width)
                for q, v, least in zip(ids.tolist(), x, floor.tolist()):
                    found, _ = tree.search(v, k, q, least)
                    rows += [(q, i, s) for s, i in found]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["query_id", "vec_id", "score"])

    wanted = cut(routed)
    pairs = wanted.select(F.col("cell").alias("c"), F.col("part").alias("p"), F.col("block").alias("b")).distinct()
    copies = forest.join(pairs, (forest["cell"] == pairs["c"]) & (forest["part"] == pairs["p"])).select("c", "p", "b", "blob")
    return copies.groupBy("c", "p", "b").cogroup(wanted.groupBy("cell", "part", "block")).applyInArrow(answer, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best for each row of queries, itself left out.

    vectors and queries: vec_id, q as from `vectors_of`.
    """
    trees, blocks = (max(1, -(-df.count() // n)) for df, n in ((vectors, TREE), (queries, QUERIES)))
    top = Top.pick(vectors, trees)
    placed = cut(_placed(vectors, top))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("far")).collect():  # at most PIVOTS rows
        top.radius[r["cell"]], top.parts[r["cell"]] = r["far"], -(-r["n"] // TREE)
    forest, asked = cut(index(placed, top)), _placed(queries, top)
    near = cut(_answers(forest, _routed(asked.withColumn("floor", F.lit(LEAST).cast("long")), top, blocks, True), k))
    floors = _best(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    bound = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "q", "cell", F.coalesce("floor", F.lit(LEAST)).alias("floor"))
    return _best(near.unionByName(_answers(forest, _routed(bound, top, blocks, False), k)), k)


def search(rows: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """top_k with the rows whose id is divisible by `every` as queries, against all rows."""
    vectors = cut(vectors_of(rows, vec_id, embedding))
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
