"""Nearest neighbours by inner product: a forest of random-projection trees and one priority queue per query.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product is the
smallest distance. Each of ``TREES`` trees halves a bounded sample (``SAMPLE`` rows, smallest hashes first) again and
again at the median of a projection on the difference of two random members. Every row is then indexed in one leaf
of every tree. A query walks all trees at once, taking the node with the smallest margin from one shared heap, until
the leaves it holds cover a share of the sample; all rows of those leaves are reranked by exact inner products. The
share is the smallest at which members of the sample find ``RECALL`` of their true neighbours in it.

Leaves travel in cells: a subtree of each tree, its rows and its queries dealt over salts so that no cell holds more
than about ``BLOCK`` of either, packed by batch. A query scores only the rows of the leaves that its queue reached.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TREES = 4
SAMPLE = 8_192
LEAF = 200
RECALL = 0.96
BLOCK = 16_384  # rows, and queries, of a cell, about
CELLS = 4  # levels of a tree that tell cells apart, at least


class Forest:
    """Complete binary trees of one depth: normals (trees, nodes, d), thresholds (trees, nodes)."""

    def __init__(self, x: np.ndarray, depth: int, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.depth, self.normals, self.cuts = depth, np.zeros((trees, 2**depth - 1, x.shape[1])), np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            parts = [np.arange(len(x))]
            for node in range(2**depth - 1):
                own = parts[node]
                a, b = x[own[rng.integers(len(own))]], x[own[rng.integers(len(own))]]
                v = a - b
                if not v.any():
                    v = rng.normal(size=x.shape[1])
                v /= np.linalg.norm(v)
                p = x[own] @ v
                cut_at = float(np.median(p))
                self.normals[t, node], self.cuts[t, node] = v, cut_at
                right = p > cut_at
                parts += [own[~right] if (~right).any() else own, own[right] if right.any() else own]
        leaves = self.leaves(x)
        self.seen = np.zeros((trees, 2**depth, len(x)), bool)  # which of the sample is in which leaf
        for t in range(trees):
            self.seen[t, leaves[t], np.arange(len(x))] = True

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree: (trees, n)."""
        out = np.zeros((len(self.normals), len(x)), np.int64)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
            out[t] = node - (2**self.depth - 1)
        return out

    def probe(self, q: np.ndarray, cover: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in the order of the shared queue, until they cover that share of the sample."""
        margins = self.normals @ q - self.cuts
        heap = [(0.0, t, 0) for t in range(len(self.normals))]
        inner, got, out = 2**self.depth - 1, np.zeros(self.seen.shape[2], bool), []
        while heap and got.sum() < cover * len(got):
            far, t, node = heapq.heappop(heap)
            while node < inner:
                m = margins[t, node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(heap, (max(far, abs(m)), t, 4 * node + 3 - near))
                node = near
            out.append((t, node - inner))
            got |= self.seen[t, node - inner]
        return out


def cover_for(forest: Forest, x: np.ndarray, lifted: np.ndarray, k: int, recall: float, asked: int = 100) -> float:
    """The smallest share of the sample (x, lifted) whose search finds that recall of the k nearest in it."""
    some = np.arange(0, len(x), max(1, len(x) // asked))
    scores = x[some] @ x.T
    scores[np.arange(len(some)), some] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    found: dict[float, list[float]] = {}
    for i, near in zip(some, true, strict=True):
        got = np.zeros(len(x), bool)
        steps = np.arange(0.1, 1.0, 0.05)
        at = 0
        for t, leaf in forest.probe(np.append(x[i], 0.0), 1.0):
            while at < len(steps) and got.mean() >= steps[at]:
                found.setdefault(round(float(steps[at]), 2), []).append(got[near].mean())
                at += 1
            got |= forest.seen[t, leaf]
        for step in steps[at:]:
            found.setdefault(round(float(step), 2), []).append(got[near].mean())
    return min((c for c, r in found.items() if np.mean(r) >= recall), default=1.0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def best(lows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest finite scores, ties to the smaller id."""
    some = np.flatnonzero(scores > -np.inf)
    if len(some) > 4 * k:
        own = scores[some]
        some = some[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return some[np.lexsort((lows[some], -scores[some]))[:k]]


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose vec_id is divisible by ``every``.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do rows without
    an id, or vectors of another length than the most common one. Equal vectors are indexed once, with their
    k + 1 smallest ids, which is all that ties can ever need; a third of all rows may be copies of one vector. An id
    on several different vectors asks once for each and is a candidate with each; it is no candidate of itself.
    No rows give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("x") == common["d"])
    few = Window.partitionBy("x").orderBy("vec_id")
    unique = good.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    unique = cut(unique.select(F.monotonically_increasing_id().alias("uid"), F.element_at("ids", 1).alias("low"), "ids", "x"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    asked = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    size = unique.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    asking = cut(good.where(asked).join(unique.select("uid", "low", "x"), "x").select(F.col("vec_id").alias("query_id"), F.col("uid").alias("query")))
    wanted = asking.select("query").distinct().join(unique.select(F.col("uid").alias("query"), "x"), "query")
    n_asked = asking.select("query").distinct().count()
    sample = unique.orderBy(F.xxhash64("x"), "low").limit(SAMPLE).select("x").toPandas()
    top = size["m"]

    def lift(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]), axis=1)

    x = matrix(sample["x"])
    depth = max(0, min(round(math.log2(max(1, size["n"] / LEAF))), int(math.log2(max(1, len(sample) / 8)))))
    forest = Forest(lift(x), depth)
    cover = cover_for(forest, x, lift(x), k, recall)
    low_bits = max(0, depth - max(CELLS, round(math.log2(max(1, size["n"] / 200_000)))))  # 6 at most, so leaves of a cell fit a word
    low_bits = min(low_bits, 6)
    salts = max(1, -(-size["n"] // 2 ** (depth - low_bits) // BLOCK))
    asking_salts = max(1, -(-n_asked // BLOCK))
    shape = "tree int, cell int, salt int, part int, query boolean, n long, ids binary, lows binary, leaves binary, x binary"
    width = x.shape[1]

    def row(t, c, s, part, query, ids, lows, leaves, rows):
        return t, c, s, part, query, len(ids), ids.astype("<i8").tobytes(), lows.astype("<i8").tobytes(), leaves.astype("<i8").tobytes(), np.ascontiguousarray(rows, "<f8").tobytes()

    def index(batches):
        for f in batches:
            rows, uid, low = matrix(f["x"]), f["uid"].to_numpy(np.int64), f["low"].to_numpy(np.int64)
            out = []
            for t, leaves in enumerate(forest.leaves(lift(rows))):
                place = (leaves >> low_bits) * salts + uid % salts
                for p in np.unique(place).tolist():
                    at = np.flatnonzero(place == p)
                    for part in range(asking_salts):
                        out.append(row(t, p // salts, p % salts, part, False, uid[at], low[at], leaves[at] & (2**low_bits - 1), rows[at]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

    def probe(batches):
        for f in batches:
            rows, uid = matrix(f["x"]), f["query"].to_numpy(np.int64)
            masks: dict[tuple[int, int, int], dict[int, int]] = {}
            for i, q in enumerate(rows):
                for t, leaf in forest.probe(np.append(q, 0.0), cover):
                    own = masks.setdefault((t, leaf >> low_bits, int(uid[i] % asking_salts)), {})
                    own[i] = own.get(i, 0) | 1 << (leaf & (2**low_bits - 1))
            out = []
            for (t, c, part), own in masks.items():
                at = np.array(list(own), np.int64)
                bits = np.array(list(own.values()), np.uint64).view(np.int64)
                out += [row(t, c, s, part, True, uid[at], uid[at], bits, rows[at]) for s in range(salts)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

    def joined(frame: pd.DataFrame):
        whole = lambda c, kind: np.frombuffer(b"".join(frame[c]), kind)
        return whole("ids", "<i8"), whole("lows", "<i8"), whole("leaves", "<i8"), whole("x", "<f8").reshape(-1, width)

    def rerank(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, list, list, list]] = []
        asks = frame["query"].to_numpy(bool)
        if asks.any() and not asks.all():
            ids, lows, leaves, rows = joined(frame[~asks])
            order = np.argsort(leaves, kind="stable")
            ids, lows, rows = ids[order], lows[order], rows[order]
            bounds = np.searchsorted(leaves[order], np.arange(2**low_bits + 1))
            queries, _, bits, wanted_rows = joined(frame[asks])
            bits = bits.view(np.uint64)
            for a in range(0, len(queries), 256):
                scores = np.full((len(queries[a : a + 256]), len(ids)), -np.inf)
                for leaf, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    at = np.flatnonzero(bits[a : a + 256] >> np.uint64(leaf) & np.uint64(1))
                    if len(at) and hi > lo:
                        scores[at, lo:hi] = wanted_rows[a + at] @ rows[lo:hi].T
                for q, line in zip(queries[a : a + 256].tolist(), scores, strict=True):
                    at = best(lows, line, k + 1)
                    if len(at):
                        out.append((q, ids[at].tolist(), lows[at].tolist(), line[at].tolist()))
        return pd.DataFrame(out, columns=["query", "uids", "lows", "scores"])

    def merge(key, frame: pd.DataFrame) -> pd.DataFrame:
        ids, first = np.unique(np.concatenate(frame["uids"].to_numpy()), return_index=True)
        scores, lows = np.concatenate(frame["scores"].to_numpy())[first], np.concatenate(frame["lows"].to_numpy())[first]
        at = best(lows, scores, k + 1)
        return pd.DataFrame({"query": key[0], "uid": ids[at], "score": scores[at]})

    members = unique.select("uid", "low", "x").mapInPandas(index, shape)
    cells = members.unionByName(wanted.mapInPandas(probe, shape)).groupBy("tree", "cell", "salt", "part")
    parts = cells.applyInPandas(rerank, "query long, uids array<long>, lows array<long>, scores array<double>")
    found = parts.groupBy("query").applyInPandas(merge, "query long, uid long, score double")
    spread = found.join(unique.select("uid", "ids"), "uid").select("query", "score", F.explode("ids").alias("vec_id"))
    # Of k + 1 for a distinct vector, one may be the asking row itself.
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = spread.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    near = cut(near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near")))
    rows = asking.join(near, "query").select("query_id", F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return rows.select("query_id", F.posexplode("near")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
