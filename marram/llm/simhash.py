"""SimHash near-duplicates, searched with pivot distance tables.

Reference fingerprints (pivots): for each block of bits the zero word and the unit words of the block. The table of
a block holds the Hamming distances of a fingerprint's block to its pivots. Two fingerprints within ``radius`` bits
of each other cannot differ in all of more than ``radius`` blocks, so in some ``agree`` = blocks - radius of them
every pivot distance is equal: joining on those tables gives all candidates. Of these, pairs go whose distances to
any full-width pivot differ by more than the radius (maximum coordinate difference; the triangle inequality), and
the rest are verified on the fingerprints themselves.

Equal fingerprints are one node. A bucket returns a spanning forest of its links, never all its pairs; a large
bucket is split again on the bits in which its members differ.

The distances to a block's pivots determine the block's bits and are determined by them, so the tables are kept
packed, as those bits: what prunes is agreement in two blocks, then four full-width pivots inside a bucket.

The pipeline's stage asks for a Jaccard similarity of 0.8 of the sets of five-word shingles. It searches the SimHash
of every set with the pivot tables as above (``pivot_ties``). Fingerprints of pairs at 0.8 differ in about 15 % of
their bits, and at that radius neither blocks nor pivots rule anything out. So the stage (``similar_groups``) adds
candidates from a prefix filter over the shingles, which misses no pair, and lets fingerprints of 128 bits discard
those (``FAR``). Whatever finds a candidate, it is verified on the sets.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, cut, shuffle_width

RADIUS = 3
BLOCKS = 5
DIRECT = 4096  # members of a bucket that are compared without splitting it
SAMPLE = 8000, 200_000  # documents, least and most, that tell common shingles from others
COMMON = 8  # documents of the sample that hold a common shingle
FAR, FAR_SHORT, SHORT = 40, 48, 16  # bits of 128 that fingerprints of similar sets differ in at most; that of short sets
FEW = 1_000_000
BLOCK = 200_000  # hashes of a family that are held together
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words in order; fewer words are one shingle, none give none."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """64 bits: bit j is set if over half the hashes have it; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of the text's shingles, repeats included."""
    return majority(shingles(text, size))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the same bits. Null texts have no words."""
    return by_text(docs, lambda texts: [np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)], "fp long")


def block_masks(blocks: int = BLOCKS) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def pivots(blocks: int = BLOCKS) -> list[np.ndarray]:
    """The reference fingerprints of each block: zero, and each of its bits alone."""
    return [np.array([0, *(1 << b for b in range(64) if m >> b & 1)], np.uint64) for m in block_masks(blocks)]


def distance_table(fps: np.ndarray, mask: int, refs: np.ndarray) -> np.ndarray:
    """Hamming distances (n, references) of the fingerprints' block to its references."""
    return np.bitwise_count((fps & np.uint64(mask))[:, None] ^ refs[None, :])


def table_keys(fps: np.ndarray, blocks: int = BLOCKS) -> list[np.ndarray]:
    """One number per fingerprint and block that stands for its row of pivot distances.

    The distance to zero and to bit b alone differ by +1 or -1 as b is in the fingerprint, so the row packs into
    one bit for each reference without loss.
    """
    out = []
    for mask, refs in zip(block_masks(blocks), pivots(blocks), strict=True):
        d = distance_table(fps, mask, refs).astype(np.int16)
        out.append(((d[:, :1] - d[:, 1:] > 0) * (np.uint64(1) << np.arange(len(refs) - 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
    return out


def far_pivots(n: int = 16) -> np.ndarray:
    """Full-width reference fingerprints for the coordinate filter."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links (index pairs) among different fingerprints of one bucket, none lost."""
    far = far_pivots()
    coords = np.bitwise_count(fps[:, None] ^ far[None, :4]).astype(np.int16)
    found: list[tuple[int, int]] = []

    def spread(rows: np.ndarray) -> None:
        """Grows each component from its first member; a member is compared only with those not reached yet."""
        left = rows
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.arange(len(left))
                for k in range(coords.shape[1]):
                    near = near[np.abs(coords[left[near], k] - coords[x, k]) <= radius]
                near = near[np.bitwise_count(fps[left[near]] ^ fps[x]) <= radius]
                if len(near):
                    got = left[near].tolist()
                    found.extend((x, y) for y in got)
                    queue += got
                    left = np.delete(left, near)

    def split(rows: np.ndarray, depth: int) -> None:
        """Members within the radius agree on one of radius + 1 parts of the bits in which the members differ."""
        if len(rows) <= DIRECT or depth == 0:
            return spread(rows)
        vary = np.bitwise_or.reduce(fps[rows] ^ fps[rows[0]])
        bits = [b for b in range(64) if int(vary) >> b & 1]
        for part in range(radius + 1):
            mask = np.uint64(sum(1 << b for b in bits[part :: radius + 1]))
            value = fps[rows] & mask
            order = np.argsort(value, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                if len(g) > 1:
                    split(np.sort(rows[g]), depth - 1 if len(g) < len(rows) // 2 else 0)

    split(np.arange(len(fps)), 4)
    return found


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) with a < b: links that connect all different fingerprints (column fp) within the radius."""
    agree = blocks - radius
    chosen = list(combinations(range(blocks), agree))
    widths = [bin(m).count("1") for m in block_masks(blocks)]

    def deal(batches):
        for frame in batches:
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            keys = table_keys(fps, blocks)
            for t, some in enumerate(chosen):
                key = np.full(len(fps), t, np.uint64)
                for b in some:
                    key = (key << np.uint64(widths[b])) | keys[b]
                yield pd.DataFrame({"bucket": key.view(np.int64), "fp": frame["fp"]})

    dealt = nodes.select("fp").mapInPandas(deal, "bucket long, fp long")

    def search(batches):
        """Rows come sorted by bucket; buckets of one member, nearly all, are passed over."""
        rest = np.empty(0, np.int64), np.empty(0, np.int64)
        for frame in batches:
            bucket = np.concatenate((rest[0], frame["bucket"].to_numpy(np.int64)))
            fp = np.concatenate((rest[1], frame["fp"].to_numpy(np.int64)))
            last = np.searchsorted(bucket, bucket[-1]) if len(bucket) else 0
            yield from emit(bucket[:last], fp[:last])
            rest = bucket[last:], fp[last:]
        yield from emit(*rest)

    def emit(bucket, fp):
        ends = np.flatnonzero(np.diff(bucket)) + 1
        lo, hi = np.concatenate(([0], ends)), np.concatenate((ends, [len(bucket)]))
        got = []
        for i in np.flatnonzero(hi - lo > 1):
            f = fp[lo[i] : hi[i]]
            got += [(int(f[x]), int(f[y])) for x, y in bucket_links(f.view(np.uint64), radius)]
        if got:
            yield pd.DataFrame({"a": [min(x) for x in got], "b": [max(x) for x in got]})

    n = shuffle_width(nodes.sparkSession)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "fp").mapInPandas(search, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): the smallest reachable label (column low of nodes) for every node that has a link.

    Alternating large-star and small-star steps on the edges, each step a written table, until nothing changes:
    the number of steps grows with the logarithm of the component size, and no vertex gathers its component.
    """
    pairs = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    before = None
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), "m", F.col("u").alias("w"))
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = cut(small)
        now = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(docs: DataFrame, size: int = 3, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows share a group. Equal
    fingerprints are aggregated before anything is dealt, so a group of copies is one node of the search.
    """
    fps = cut(fingerprints(docs, size))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(nodes, links(nodes, radius, blocks))
    roots = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(roots.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of the text's set of shingles; a text without words has one empty shingle."""
    h = shingles(text, size)
    return np.unique(h) if len(h) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """One signed long per set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits over the set: the majority of the hashes and that of the hashes mixed again."""
    again = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return majority(hashes), majority(again ^ (again >> np.uint64(29)))


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that ``COMMON`` or more of a sample of documents hold.

    The sample is a fiftieth of the rows within the bounds ``SAMPLE``. It only sets the order in which shingles are
    tried, so it decides about speed and never about results; a document of n shingles can add no more than
    n / COMMON to their number.
    """
    rows = max(1, docs.count())
    most = min(max(rows // 50, SAMPLE[0]), SAMPLE[1])

    def run(batches):
        for frame in batches:
            sets = [shingle_set(t if isinstance(t, str) else None, size) for t in frame["text"]]
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 1_000_000 * min(1.0, most / rows)).select("text")
    counts = some.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select("h")
    return np.sort(counts.toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def prefix(hashes: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in the order "common ones last, then by hash": two sets at ``least`` share one of these."""
    n = len(hashes)
    late = np.isin(hashes, common, assume_unique=True)
    return np.concatenate((hashes[~late], hashes[late]))[: n - math.ceil(least * n - 1e-9) + 1]


def bucket_ties(node: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one bucket that sizes and fingerprints do not rule out."""
    found, left = [], np.arange(len(node))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            bits = np.bitwise_count(one[left] ^ one[x]).astype(np.int64) + np.bitwise_count(two[left] ^ two[x])
            low, high = np.minimum(n[left], n[x]), np.maximum(n[left], n[x])
            near = (bits <= np.where(low < SHORT, FAR_SHORT, FAR)) & (low >= least * high - 1e-9)
            if near.any():
                got = left[near].tolist()
                found += [(int(node[x]), int(node[y])) for y in got]
                queue += got
                left = left[~near]
    return found


def candidate_ties(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of nodes that connect all nodes which share a shingle of both prefixes and may reach ``least``.

    A bucket of k members gives at most k - 1 of them, so their number never exceeds that of the rows dealt.
    """

    def search(batches):
        names = ("token", "node", "n", "one", "two")
        rest = [np.empty(0, np.int64) for _ in names]
        for frame in batches:
            all_of = [np.concatenate((r, frame[c].to_numpy(np.int64))) for r, c in zip(rest, names, strict=True)]
            last = np.searchsorted(all_of[0], all_of[0][-1]) if len(all_of[0]) else 0
            yield from emit(*[x[:last] for x in all_of])
            rest = [x[last:] for x in all_of]
        yield from emit(*rest)

    def emit(token, node, n, one, two):
        ends = np.flatnonzero(np.diff(token)) + 1
        lo, hi = np.concatenate(([0], ends)), np.concatenate((ends, [len(token)]))
        one, two = one.view(np.uint64), two.view(np.uint64)
        x = lo[hi - lo == 2]  # most buckets have one member or two
        bits = np.bitwise_count(one[x] ^ one[x + 1]).astype(np.int64) + np.bitwise_count(two[x] ^ two[x + 1]) if len(x) else np.zeros(0, np.int64)
        low, high = (np.minimum(n[x], n[x + 1]), np.maximum(n[x], n[x + 1])) if len(x) else (bits, bits)
        x = x[(bits <= np.where(low < SHORT, FAR_SHORT, FAR)) & (low >= least * high - 1e-9)]
        if len(x):
            yield pd.DataFrame({"a": node[x], "b": node[x + 1]})
        for i in np.flatnonzero(hi - lo > 2):
            s = slice(lo[i], hi[i])
            got = bucket_ties(node[s], n[s], one[s], two[s], least)
            if got:
                yield pd.DataFrame(got, columns=["a", "b"])

    dealt = nodes.select(F.explode("prefix").alias("token"), "node", "n", "one", "two")
    width = shuffle_width(nodes.sparkSession)
    ties = dealt.repartition(width, "token").sortWithinPartitions("token", "node").mapInPandas(search, "a long, b long")
    return ties.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pivot_ties(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of nodes that connect all whose SimHash (column one) differs in at most ``radius`` bits, found by
    the pivot tables; nodes with one SimHash are tied to the least of them."""
    prints = cut(nodes.groupBy(F.col("one").alias("fp")).agg(F.min("node").alias("first")))
    same = nodes.join(prints, nodes["one"] == prints["fp"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, two = (prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab")
    near = links(prints, radius).join(one, "a").join(two, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return same.unionByName(near)


def few(ids: DataFrame) -> DataFrame:
    """The ids, to be broadcast if they were counted to be at most ``FEW``; texts joined to more of them are shuffled."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, h): the hashes of the shingle sets of nodes (node, low), taken from the documents that lead them."""

    def run(batches):
        for frame in batches:
            sets = [shingle_set(t if isinstance(t, str) else None, size) for t in frame["text"]]
            yield pd.DataFrame({"node": np.array([set_key(h) for h in sets], np.int64), "h": [h.tobytes() for h in sets]})

    led = docs.select("doc_id", "text").join(few(nodes.select(F.col("low").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    return led.mapInPandas(run, "node long, h binary").join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("h").alias("h"))


def similar_groups(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, node and component_id (smallest doc_id reachable over links) of every row; a link joins two texts whose
    sets of shingles have a Jaccard similarity of at least ``least``.

    Texts with equal sets are one node. Nodes with a near SimHash are tied by the pivot tables. Two sets at ``least`` share one of the first (1 - least) n + 1 shingles of
    each in any common order (prefix filter), so those are dealt by hash. In a bucket of any size sizes and
    fingerprints rule pairs out, and a spanning forest of the others ties nodes into families; inside a family every
    pair meets on its sets. No rows give no rows; texts without words are alike; null ids are not allowed here.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def columns(texts):
        sets = [shingle_set(t, size) for t in texts]
        wide = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
        first = [prefix(h, common.value, least).view(np.int64) for h in sets]
        return [np.array([set_key(h) for h in sets], np.int64), np.array([len(h) for h in sets], np.int64), wide[:, 0].copy(), wide[:, 1].copy(), first]

    rows = cut(by_text(docs, columns, "node long, n long, one long, two long, prefix array<long>"))
    shared = [F.first(c).alias(c) for c in ("n", "one", "two", "prefix")]
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), *shared)
    ties = cut(candidate_ties(nodes, least).unionByName(pivot_ties(nodes)))
    links = family_links(docs, nodes.select("node", "low", "n"), ties, size, least)
    lows = nodes.select("node", "low")
    found = components(lows, links)
    roots = lows.join(found, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "node").join(roots.join(lowest, "root").select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def grow(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links (index pairs) among the sets: a member is claimed only over a verified link."""
    sizes = np.array([len(x) for x in sets])
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    mark, found, left = np.zeros(len(words), bool), [], np.arange(len(sets))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        flat, starts = np.concatenate([ids[i] for i in left]), np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
        while queue and len(left):
            x = queue.pop()
            mark[ids[x]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[ids[x]] = False
            near = both >= least * (sizes[left] + sizes[x] - both)
            if near.any():
                queue += left[near].tolist()
                found += [(x, y) for y in left[near].tolist()]
                left = left[~near]
                if len(left):
                    flat, starts = np.concatenate([ids[i] for i in left]), np.concatenate(([0], np.cumsum(sizes[left])[:-1]))
    return found


def family_links(docs: DataFrame, nodes: DataFrame, ties: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): verified links that connect all that is linked within the families of the ties (a, b).

    Sets travel once to the task of their family. A family of more than ``BLOCK`` hashes is cut into blocks and every
    two blocks are grown together, so each pair of members meets in some task and no task holds more than about two.
    """
    found = components(nodes, ties)
    members = cut(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).join(nodes, "node"))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    placed = members.join(blocks, "root").withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))
    placed = placed.select("node", "root", "i", F.explode(F.expr("if(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), j -> j <> i))")).alias("j"))
    dealt = placed.select("root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node").join(sets_of(docs, members, size), "node")

    def run(frame):
        node = frame["node"].to_numpy(np.int64)
        got = grow([np.frombuffer(h, np.uint64) for h in frame["h"]], least)
        return pd.DataFrame({"a": [node[x] for x, _ in got], "b": [node[y] for _, y in got]}, dtype=np.int64)

    return dealt.groupBy("root", "i", "j").applyInPandas(run, "a long, b long")


def keep_first(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows, with their columns, that lead their group of near-duplicates (component_id = doc_id).

    Links: all pairs whose five-word shingles have a Jaccard similarity of ``least`` or more. Rows that repeat an id
    share its fate. Rows without an id stay. Null, empty and blank texts are one group. No rows give no rows; other
    columns may have any name.
    """
    got = few(similar_groups(docs.where("doc_id is not null"), size, least).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(got, "doc_id", "left_anti").select(*docs.columns)
