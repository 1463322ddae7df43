"""Exact top-k search by inner product over a paged M-tree, best first.

The root's entries are pivots, drawn from the vectors by a hash (at most
``PIVOTS``, and ``PIVOT_BYTES`` in all): each vector belongs to its nearest pivot,
whose covering radius is the distance of its farthest vector.  The vectors of a
pivot lie in pages of about ``PAGE_ROWS``; each page is one subtree, built and searched
in one task.  A node has a routing object, a covering radius and its distance to
its parent's routing object; a leaf keeps every entry's distance to the leaf's
routing object.  For a query q and a ball with centre c and radius r, no entry
scores above ``q.c + |q| r``.

A query first searches the page that it lies in itself.  Its k-th best score
there is a bound to begin with: it is sent only to the pivots whose ball can hold
more, and there starts from that bound.  Within a page the search takes nodes in
the order of their bounds and ends when the k-th best score known exceeds the
next one.  Before a product with a child's centre (or a leaf's entry) is
computed, the stored distance d to its parent p bounds it: ``q.c <= q.p + |q| d``;
what that excludes is never computed.  Vectors without any structure, such as
independent directions in many dimensions, let no bound exclude much; all
products are computed then, in leaves of ``LEAF`` entries at once.

Scores are integers and compared exactly; bounds are widened by a relative
1e-9, so rounding can only cause extra work.  Queries come to a page in blocks;
each page returns at most k rows for each query and a last step keeps the k best
of all pages.

Cases: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows with a null id.  Scores are longs; vectors whose products
pass 2**63 have no defined score.
A query meets candidates of its own length only.  Ties go to the smaller id; a
repeated id is a candidate as often as it stands there with different vectors,
once otherwise, and never for itself.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of one page, children of one node, entries of one leaf, queries of one block.
PAGE_ROWS, NODE, LEAF, BLOCK = 8192, 64, 512, 8192
#: Most pivots, and bytes that they may take; they are broadcast.
PIVOTS, PIVOT_BYTES = 4096, 16 << 20
_WIDE = 1e-9


class Node:
    __slots__ = ("center", "radius", "to_parent", "rows", "ids", "dist", "children", "centers", "dists", "radii")

    def __init__(self, x: np.ndarray, ids: np.ndarray, center: np.ndarray, parent: np.ndarray | None, rng):
        d = np.sqrt(((x - center) ** 2).sum(1))
        self.center, self.radius = center, float(d.max())
        self.to_parent = 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum()))
        self.children: list[Node] = []
        if len(x) <= LEAF or self.radius == 0:
            self.rows, self.ids, self.dist = x, ids, d
            return
        fan = min(NODE, max(2, -(-len(x) // LEAF)))
        # routing objects: members far from each other among a few drawn ones
        drawn = x[rng.choice(len(x), min(len(x), 4 * fan), replace=False)]
        chosen = [drawn[0]]
        far = ((drawn - drawn[0]) ** 2).sum(1)
        while len(chosen) < fan and far.max() > 0:
            chosen.append(drawn[int(far.argmax())])
            far = np.minimum(far, ((drawn - chosen[-1]) ** 2).sum(1))
        if len(chosen) == 1:  # the drawn ones are equal: the row farthest from them is the second
            chosen.append(x[int(d.argmax())] if (x[int(d.argmax())] != drawn[0]).any() else center)
        c = np.array(chosen)
        of = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        if np.bincount(of, minlength=len(c)).max() == len(x):
            self.rows, self.ids, self.dist = x, ids, d
            return
        self.children = [Node(x[of == k], ids[of == k], c[k], center, rng) for k in range(len(c)) if (of == k).any()]
        self.centers = np.array([n.center for n in self.children])
        self.dists = np.array([n.to_parent for n in self.children])
        self.radii = np.array([n.radius for n in self.children])


def build(x: np.ndarray, ids: np.ndarray) -> Node:
    return Node(x, ids, np.round(x.mean(0)), None, np.random.default_rng(0))


def search(root: Node, q: np.ndarray, own: int, k: int, enough: float = -np.inf) -> list[tuple[int, int]]:
    """The k best (score, id) of those that score ``enough`` at least, best first."""
    size = float(np.sqrt(q @ q))
    # sums of products beyond 2**53 need whole numbers; bounds may stay rounded
    exact = q.astype(np.int64) if size * (root.radius + float(np.sqrt(root.center @ root.center))) >= 2**52 else None
    best: list[tuple[int, int]] = []  # a heap; (score, -id), so the worst is first
    at = float(q @ root.center)
    heap = [(-(at + size * root.radius), 0, at, root)]
    pushed = 0
    while heap:
        bound, _, at, node = heapq.heappop(heap)
        slack = _WIDE * (1 + abs(bound) + size)
        least = max(best[0][0], enough) if len(best) == k else enough
        if -bound + slack < least:
            break
        if node.children:
            able = np.flatnonzero(at + size * (node.dists + node.radii) + slack >= least)
            product = node.centers[able] @ q
            upper = product + size * node.radii[able]
            for i, p, u in zip(able, product, upper, strict=True):
                if u + slack >= least:
                    pushed += 1
                    heapq.heappush(heap, (-float(u), pushed, float(p), node.children[i]))
            continue
        able = np.flatnonzero(at + size * node.dist + slack >= least)
        score = node.rows[able] @ q if exact is None else node.rows[able].astype(np.int64) @ exact
        hit = score >= least
        able, score = able[hit], score[hit]
        if len(score) > 4 * k:  # of many the k best, and one that may be the query itself
            hit = np.lexsort((node.ids[able], -score))[: k + np.count_nonzero(node.ids[able] == own)]
            able, score = able[hit], score[hit]
        for s, i in zip(score, node.ids[able], strict=True):
            if i != own:
                entry = (int(s), -int(i))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _vectors(lists) -> np.ndarray:
    return np.array(lists, np.float64)


def _nearest(pivots: dict[int, np.ndarray]):
    """Of each vector: its nearest pivot, by number among those of its length (-1: there is none), and the distance; else its length."""

    def run(batches):
        for b in batches:
            dims, lists = b.column("dim").to_numpy(), b.column("v").to_pylist()
            pivot, dist = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _vectors([lists[k] for k in at])
                if int(dim) not in pivots:
                    dist[at] = np.sqrt((x**2).sum(1))
                    continue
                c = pivots[int(dim)]
                near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
                pivot[at], dist[at] = near, np.sqrt(((x - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("id"), b.column("v"), pa.array(pivot), pa.array(dist)], names=["dim", "id", "v", "pivot", "dist"])

    return run


def _sent(directory):
    """For each query, the pages that can hold what it needs, but for its own."""

    def run(batches):
        entries = directory.value
        few = max(1, 4096 // max([1, *(int(x[2].sum()) for x in entries.values())]))  # queries whose rows are made at once
        for b in (x.slice(k, few) for x in batches for k in range(0, x.num_rows, few)):
            of, pivots, pages = [], [], []
            for k, r in enumerate(b.select(["dim", "pivot", "page", "v", "enough"]).to_pylist()):
                centers, radii, n_pages, numbers = entries.get(r["dim"], entries[None])
                q = np.array(r["v"], np.float64)
                size = float(np.sqrt(q @ q))
                upper = (centers @ q if centers is not None else 0.0) + size * radii
                least = -np.inf if r["enough"] is None else r["enough"]
                for i in np.flatnonzero(upper + _WIDE * (1 + np.abs(upper) + size) >= least):
                    p = int(numbers[i])
                    mine = [x for x in range(int(n_pages[i])) if (p, x) != (r["pivot"], r["page"])]
                    of += [k] * len(mine)
                    pivots += [p] * len(mine)
                    pages += mine
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("dim").take(at), pa.array(pivots, pa.int32()), pa.array(pages, pa.int32()), b.column("id").take(at), b.column("v").take(at), b.column("enough").take(at)], names=["dim", "pivot", "page", "id", "v", "enough"])

    return run


_FOUND = "query_id long, vec_id long, score long"


def _searched(k: int, seed: bool):
    """The best of one page for a block of queries; with ``seed`` also each query's row with its k-th best score."""

    def run(left, right):
        import pandas as pd

        out, seeds = [], []
        if len(left) and len(right):
            left = left.sort_values("id")
            tree = build(_vectors(left["v"].tolist()), left["id"].to_numpy(np.int64))
            enough = [-np.inf] * len(right) if seed else right["enough"].fillna(-np.inf).tolist()
            for i, v, e in zip(right["id"], right["v"], enough, strict=True):
                best = search(tree, np.array(v, np.float64), int(i), k, e)
                out += [(int(i), c, s) for s, c in best]
                seeds.append((int(i), None, best[-1][0] if len(best) == k else None, v))
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("Int64")
        if not seed:
            return found
        first = pd.DataFrame(seeds, columns=["query_id", "vec_id", "score", "v"]).astype({"query_id": "Int64", "vec_id": "Int64", "score": "Int64"})
        return pd.concat([found.assign(v=None), first])[["query_id", "vec_id", "score", "v"]]

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row for which ``is_query`` (a Column over ``id``) holds."""
    from regionframe.llm.store import small_or_shuffled, written

    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    src = src.filter("NOT exists(v, e -> e IS NULL OR isnan(e) OR abs(e) = double('infinity'))")
    src = src.select("id", F.expr(f"transform(v, e -> CAST(floor(e * {scale}) AS DOUBLE))").alias("v")).distinct().withColumn("dim", F.size("v"))
    src = written(src, "vectors")
    n, widest = src.agg(F.count(F.lit(1)), F.max("dim")).first()
    most = max(1, min(PIVOTS, -(-n // (PAGE_ROWS // 2)), PIVOT_BYTES // (8 * (widest or 1))))
    pivots: dict[int, np.ndarray] = {}
    for r in src.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(most).collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    pivots = {dim: np.unique(_vectors(v), axis=0) for dim, v in pivots.items()}
    dealt = written(src.select("dim", "id", "v").mapInArrow(_nearest(pivots), "dim int, id long, v array<double>, pivot int, dist double"), "dealt")
    # one row for each pivot, and one for all vectors whose length no pivot has
    sizes = dealt.groupBy(F.when(F.col("pivot") >= 0, F.col("dim")).alias("of"), "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).withColumn("pages", F.expr(f"CAST(greatest(1, n DIV {PAGE_ROWS // 2}) AS INT)"))
    by: dict = {None: []}
    for r in sizes.orderBy("of", "pivot").collect():
        by.setdefault(r["of"], []).append(r)
    directory = {dim: (pivots[dim][[r["pivot"] for r in rs]] if dim else None, np.array([r["radius"] for r in rs], float), np.array([r["pages"] for r in rs], int), np.array([r["pivot"] for r in rs], int)) for dim, rs in by.items()}
    held = spark.sparkContext.broadcast(directory)
    pages = small_or_shuffled(sizes.select(F.coalesce("of", F.lit(-1)).alias("of"), "pivot", "pages"), sum(map(len, by.values())), 24)
    placed = dealt.withColumn("of", F.when(F.col("pivot") >= 0, F.col("dim")).otherwise(-1)).join(pages, ["of", "pivot"])
    placed = written(placed.select("dim", "pivot", F.pmod(F.xxhash64("id", F.lit(5)), "pages").cast("int").alias("page"), "id", "v"), "placed")

    queries = placed.filter(is_query)
    blocks = max(1, -(-queries.count() // (BLOCK // 2)))
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block")
    copies = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "pivot", "page", "block"]
    met = lambda asked: copies.groupBy(*key).cogroup(asked.groupBy(*key))
    seeded = written(met(queries.select("*", block)).applyInPandas(_searched(k, True), _FOUND + ", v array<double>"), "seeded")
    enough = seeded.filter("vec_id IS NULL").select(F.col("query_id").alias("id"), "v", F.col("score").cast("double").alias("enough"))
    sent = queries.join(enough, ["id", "v"]).select("dim", "pivot", "page", "id", "v", "enough").mapInArrow(_sent(held), "dim int, pivot int, page int, id long, v array<double>, enough double")
    rest = met(sent.select("*", block)).applyInPandas(_searched(k, False), _FOUND)
    found = seeded.filter("vec_id IS NOT NULL").select("query_id", "vec_id", "score").unionByName(rest).distinct()
    return found.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT)")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
