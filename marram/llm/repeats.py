"""Long repeats between documents: what suffix-array and FM-index dedup share.

A window is ``WIDTH`` consecutive symbols (bytes or words) of one document. Both operators need, for every window of
a document, the smallest doc_id that holds the same window. Windows reach their shard by content: a window's key is
the smallest hash of the ``GRAM``-symbol strings inside it, so equal windows meet in one shard, and neighbouring
windows mostly share a key and travel as one *context*, the stretch of text that they cover together.

1. Documents are gathered in *units* of about ``UNIT_BYTES``, by doc_id range (generation) and hash.
2. Each unit sends its distinct keys, four bytes each; shards answer which of them a second unit has.
3. Each unit sends its distinct contexts of shared keys, each once with the smallest doc_id that holds it there.
4. Shards search their contexts with the operator's index, and answer per context from which window to which a
   smaller doc_id than the unit's own was found.
5. Each unit resolves its documents and lays the covered windows over them.

A passage that a third of all documents share is thus sent once by each unit, however many of its documents hold it.
Shards and units grow in number with the input and not in size; keys and answers are packed, so few rows move.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

WIDTH = 50
UNIT_BYTES = 6_000_000
SHARD_BYTES = 6_000_000
GENERATIONS = 8  # batches by doc_id; their number changes the work and not the result
PARTITION_BYTES = 24_000_000  # of text that a task takes, unit by unit
CHUNK = 1 << 18  # symbols hashed at a time
NONE = np.iinfo(np.int64).max
ODD = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive symbols, by doubling."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(ODD, n, 1 << 64))

    done, length, h, n = None, 0, symbols, 1
    while True:
        if k & n:
            if done is None:
                done, length = h, n
            else:
                m = len(symbols) - length - n + 1
                done, length = h[:m] * power(length) + done[n : n + m], length + n
        if 2 * n > k:
            return mixed(done)
        h, n = h[:-n] * power(n) + h[n:], 2 * n


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    n = 1
    m = h
    while 2 * n <= w:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[: len(m) - (w - n)], m[w - n :]) if n < w else m


class Bytes:
    """Documents as UTF-8 bytes."""

    gram = 24

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "replace")
        self.n = len(self.data)

    def symbols(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8).astype(np.uint64) + np.uint64(1)

    def cut(self, lo: int, hi: int) -> bytes:
        return self.data[lo:hi]

    def kept(self, keep: np.ndarray) -> bytes:
        return np.frombuffer(self.data, np.uint8)[keep].tobytes()


class Words:
    """Documents as words; contexts are words joined by one space."""

    gram = 20

    def __init__(self, text: str):
        words = text.encode("utf-8", "replace").split()
        self.data = b" ".join(words)
        self.n = len(words)
        size = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size

    def symbols(self) -> np.ndarray:
        """A polynomial hash of each word, from one running sum over the bytes."""
        data = np.frombuffer(self.data, np.uint8).astype(np.uint64) + np.uint64(1)
        powers = np.full(len(data), ODD, np.uint64)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * powers, dtype=np.uint64)))
        back = np.full(len(data), pow(ODD, -1, 1 << 64), np.uint64)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        return mixed((total[self.ends] - total[self.starts]) * back[self.starts])

    def cut(self, lo: int, hi: int) -> bytes:
        return self.data[self.starts[lo] : self.ends[hi - 1]]

    def kept(self, keep: np.ndarray) -> bytes:
        words = self.data.split(b" ") if self.n else []
        return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def runs(views: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of windows that share a key: key, document, first window, last window + 1."""
    out, group, size = [], [], 0

    def flush() -> None:
        if not group:
            return
        symbols = np.concatenate([views[i].symbols() for i in group])
        lengths = np.array([views[i].n for i in group])
        gram = views[group[0]].gram
        minima = window_minima(gram_hashes(symbols, gram), WIDTH - gram + 1)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        edge = np.zeros(len(minima) + 1, np.int8)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + lengths - WIDTH + 1, len(minima)), -1)
        valid = np.cumsum(edge[:-1]) > 0
        change = np.flatnonzero((minima[1:] != minima[:-1]) | (valid[1:] != valid[:-1])) + 1
        lo = np.concatenate(([0], change))
        hi = np.concatenate((change, [len(minima)]))
        ok = valid[lo]
        lo, hi = lo[ok], hi[ok]
        doc = np.searchsorted(starts, lo, side="right") - 1
        out.append((minima[lo], np.array(group)[doc], lo - starts[doc], hi - starts[doc]))

    for i, view in enumerate(views):
        if view.n >= WIDTH:
            group.append(i)
            size += view.n
            if size >= CHUNK:
                flush()
                group, size = [], 0
    flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Unit:
    """The distinct texts of a unit with their smallest id, and the runs of their windows."""

    def __init__(self, frame: pd.DataFrame, view: type, shards: int):
        self.low: dict[str, int] = {}
        for doc, text in zip(frame["doc_id"].tolist(), frame["text"], strict=True):
            text = text if isinstance(text, str) else ""
            self.low[text] = min(doc, self.low.get(text, doc))
        self.texts = sorted(self.low)  # rows arrive in any order, and every pass must number contexts alike
        self.views = [view(t) for t in self.texts]
        self.ids = np.array([self.low[t] for t in self.texts], np.int64)
        self.key, self.text, self.lo, self.hi = runs(self.views)
        spread = mixed(self.key ^ np.uint64(ODD))
        self.shard_of = (spread % np.uint64(shards)).astype(np.int64)
        #: Distinct keys by shard; first stands for each run's place among them.
        order = np.lexsort((self.key, self.shard_of))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.key[order][1:] != self.key[order][:-1]) | (self.shard_of[order][1:] != self.shard_of[order][:-1])
        place = np.cumsum(fresh) - 1
        self.place = np.empty(len(order), np.int64)
        self.place[order] = place
        head = order[fresh]
        self.shards, self.tags = self.shard_of[head], (spread[head] >> np.uint64(32)).astype(np.uint32)
        #: Keys that two texts of the unit have.
        n = place[-1] + 1 if len(place) else 0
        least, most = np.full(n, len(self.texts)), np.full(n, -1)
        np.minimum.at(least, self.place, self.text)
        np.maximum.at(most, self.place, self.text)
        self.local = least != most

    def by_shard(self):
        """(shard, slice of the distinct keys)."""
        if len(self.shards):
            ends = np.concatenate((np.flatnonzero(np.diff(self.shards)) + 1, [len(self.shards)]))
            at = 0
            for end in ends:
                yield int(self.shards[at]), slice(at, end)
                at = end

    def contexts(self, answers: dict[int, bytes]) -> dict[int, tuple[dict[bytes, int], list[int], list[int]]]:
        """Per shard: distinct contexts by number, their smallest ids, and (run, number) pairs, for shared keys."""
        shared = self.local.copy()
        for shard, part in self.by_shard():
            if shard in answers:
                n = part.stop - part.start
                shared[part] |= np.unpackbits(np.frombuffer(answers[shard], np.uint8))[:n].astype(bool)
        out: dict[int, tuple[dict, list, list]] = {}
        for r in np.flatnonzero(shared[self.place] if len(self.place) else []):
            numbers, lows, members = out.setdefault(int(self.shard_of[r]), ({}, [], []))
            t = self.text[r]
            context = self.views[t].cut(self.lo[r], self.hi[r] + WIDTH - 1)
            doc = int(self.ids[t])
            k = numbers.get(context)
            if k is None:
                k = numbers[context] = len(lows)
                lows.append(doc)
            elif doc < lows[k]:
                lows[k] = doc
            members.append((int(r), k))
        return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers in one compressed value."""
    head = np.array([len(a) for a in arrays], "<i8")
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a, "<i8").tobytes() for a in arrays), 1)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), "<i8")
    ends = n + np.cumsum(raw[:n])
    return [raw[e - k : e] for e, k in zip(ends, raw[:n], strict=True)]


def pack_contexts(contexts: list[bytes], lows: list[int]) -> bytes:
    return zstandard.compress(packed_head(lows, contexts) + b"".join(contexts), 1)


def packed_head(lows: list[int], contexts: list[bytes]) -> bytes:
    return np.array([len(lows), *lows, *map(len, contexts)], "<i8").tobytes()


def unpack_contexts(data: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    head = np.frombuffer(raw[8 : 8 + 16 * n], "<i8")
    ends = 8 + 16 * n + np.cumsum(head[n:])
    return [raw[e - k : e] for e, k in zip(ends.tolist(), head[n:].tolist(), strict=True)], head[:n]


#: An index takes the generations of a shard, each a list of (distinct contexts, smallest id of each), and gives for
#: each generation the smallest id of every window of its contexts among this and all earlier generations, in one
#: array, and where the contexts begin in it (with the end).
Index = Callable[[list[tuple[list[bytes], np.ndarray]]], list[tuple[np.ndarray, np.ndarray]]]


def remove(docs: DataFrame, view: type, index: Index) -> DataFrame:
    """doc_id, n (symbols), spans (array of struct(start, end) of removed symbols), and kept, the bytes that are left.

    A row loses the symbols of its windows that a smaller doc_id holds. Null texts are empty. Rows without an id
    neither lose nor take. Rows that repeat an id do not cover each other. Equal texts are worked on once in each
    unit. Long texts are read whole. Other columns are ignored, whatever their names; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nameless, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")  # ids beside nulls would not stay exact in pandas
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = sorted(set(docs.approxQuantile("doc_id", [i / GENERATIONS for i in range(1, GENERATIONS)], 0.01)))
    subs = max(1, -(-total // (UNIT_BYTES * GENERATIONS)))
    shards = max(4, -(-total // SHARD_BYTES))
    parts = max(shuffle_width(spark), -(-total // PARTITION_BYTES))
    generation = sum(((F.col("doc_id") > F.lit(int(m))).cast("int") for m in marks), F.lit(0))
    unit = F.coalesce(generation, F.lit(0)) * F.lit(subs) + F.pmod(F.xxhash64("doc_id"), F.lit(subs))
    units = docs.select(unit.cast("long").alias("unit"), "doc_id", "text").repartition(parts, "unit")
    mail = "shard long, unit long, kind int, data binary"

    def keys(name, frame: pd.DataFrame) -> pd.DataFrame:
        u = Unit(frame, view, shards)
        rows = [(s, name[0], 0, u.tags[p].tobytes()) for s, p in u.by_shard()]
        return pd.DataFrame(rows, columns=["shard", "unit", "kind", "data"])

    def shared(name, frame: pd.DataFrame) -> pd.DataFrame:
        tags = [np.frombuffer(d, np.uint32) for d in frame["data"]]
        owner, every = np.repeat(np.arange(len(tags)), [len(t) for t in tags]), np.concatenate(tags)
        order = np.argsort(every, kind="stable")  # within a tag, units stay in order
        every, owner = every[order], owner[order]
        head = np.concatenate(([0], np.flatnonzero(every[1:] != every[:-1]) + 1))
        size = np.diff(np.append(head, len(every)))
        several = np.empty(len(every), bool)
        several[order] = np.repeat(owner[head] != owner[head + size - 1], size)
        ends = np.cumsum([len(t) for t in tags])
        rows = [(name[0], u, 0, np.packbits(several[e - len(t) : e]).tobytes()) for u, t, e in zip(frame["unit"], tags, ends.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["shard", "unit", "kind", "data"])

    def answers_of(frame: pd.DataFrame, kind: int) -> dict[int, bytes]:
        some = frame[frame["kind"] == kind]
        return dict(zip(some["shard"].tolist(), some["data"], strict=True))

    def contexts(name, frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        u = Unit(frame, view, shards)
        rows = [(s, name[0], 1, pack_contexts(list(numbers), lows)) for s, (numbers, lows, _) in u.contexts(answers_of(replies, 0)).items()]
        return pd.DataFrame(rows, columns=["shard", "unit", "kind", "data"])

    def searched(name, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("unit", kind="stable")
        sent = [unpack_contexts(d) for d in frame["data"]]
        batches, where, last = [], [], None
        for u, (texts, lows) in zip(frame["unit"], sent, strict=True):
            if u // subs != last:  # a new generation
                last, known = u // subs, {}
                batches.append(([], []))
            own = []
            for text, low in zip(texts, lows.tolist(), strict=True):
                k = known.get(text)
                if k is None:
                    k = known[text] = len(batches[-1][0])
                    batches[-1][0].append(text)
                    batches[-1][1].append(low)
                elif low < batches[-1][1][k]:
                    batches[-1][1][k] = low
                own.append(k)
            where.append((len(batches) - 1, own))
        found = index([(texts, np.array(lows, np.int64)) for texts, lows in batches])
        least = [np.minimum.reduceat(ids, first[:-1]) for ids, first in found]
        most = [np.maximum.reduceat(ids, first[:-1]) for ids, first in found]
        rows = []
        for u, (_, lows), (b, own) in zip(frame["unit"], sent, where, strict=True):
            (ids, first), at = found[b], np.array(own, np.int64)
            smaller = least[b][at] < lows
            even = smaller & (most[b][at] == least[b][at])  # one id for the whole context
            k = np.flatnonzero(even)
            parts_of = [(k, np.zeros(len(k), np.int64), first[at[k] + 1] - first[at[k]], least[b][at[k]])]
            for k in np.flatnonzero(smaller & ~even).tolist():
                row = ids[first[at[k]] : first[at[k] + 1]]
                lo = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
                hi, ok = np.append(lo[1:], len(row)), row[lo] < lows[k]
                parts_of.append((np.full(ok.sum(), k), lo[ok], hi[ok], row[lo[ok]]))
            columns = [np.concatenate(x) for x in zip(*parts_of, strict=True)]
            if len(columns[0]):
                rows.append((name[0], u, 1, packed(*columns)))
        return pd.DataFrame(rows, columns=["shard", "unit", "kind", "data"])

    def resolve(name, frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        u = Unit(frame, view, shards)
        smaller = answers_of(replies, 1)
        base = np.concatenate(([0], np.cumsum([v.n + 1 for v in u.views]))).astype(np.int64)
        edge = np.zeros(base[-1] + 1, np.int64)

        def cover(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            np.add.at(edge, base[text] + lo, 1)
            np.add.at(edge, base[text] + hi + WIDTH - 1, -1)

        for shard, (_, lows, members) in u.contexts(answers_of(replies, 0)).items():
            run, number = np.array(members, np.int64).T
            text, lo = u.text[run], u.lo[run]
            whole = np.array(lows, np.int64)[number] < u.ids[text]
            cover(text[whole], lo[whole], u.hi[run[whole]])
            if shard in smaller:
                k, a, z, d = unpacked(smaller[shard], 4)
                # The pieces of a context are neighbours once sorted; each member meets all of its context's.
                order = np.argsort(k, kind="stable")
                k, a, z, d = k[order], a[order], z[order], d[order]
                left, right = np.searchsorted(k, number, "left"), np.searchsorted(k, number, "right")
                size = np.where(whole, 0, right - left)
                member = np.repeat(np.arange(len(number)), size)
                piece = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(size.sum())
                ok = d[piece] < u.ids[text[member]]
                member, piece = member[ok], piece[ok]
                cover(text[member], lo[member] + a[piece], lo[member] + z[piece])
        outcome = {}
        depth = np.cumsum(edge)
        for t, v in enumerate(u.views):
            gone = depth[base[t] : base[t] + v.n] > 0
            outcome[u.texts[t]] = (v.n, edges_of(gone), v.kept(~gone) if gone.any() else v.data)
        rows = []
        for doc, text in zip(frame["doc_id"].tolist(), frame["text"], strict=True):
            text = text if isinstance(text, str) else ""
            n, spans, kept = outcome[text]
            if doc > u.low[text] and n >= WIDTH:  # the unit holds the whole text under a smaller id
                spans, kept = [0, n], b""
            rows.append((doc, n, spans, kept))
        return pd.DataFrame(rows, columns=["doc_id", "n", "edges", "kept"])

    def whole(batches):
        for frame in batches:
            views = [view(t if isinstance(t, str) else "") for t in frame["text"]]
            yield pd.DataFrame({"n": [v.n for v in views], "kept": [v.data for v in views]})

    sent = units.groupBy("unit").applyInPandas(keys, mail)
    known = sent.repartition(parts, "shard").groupBy("shard").applyInPandas(shared, mail).repartition(parts, "unit")
    asked = units.groupBy("unit").cogroup(known.groupBy("unit")).applyInPandas(contexts, mail)
    found = asked.repartition(parts, "shard").groupBy("shard").applyInPandas(searched, mail)
    replies = known.unionByName(found.repartition(parts, "unit"))
    named = units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInPandas(resolve, "doc_id long, n long, edges array<long>, kept binary")
    others = nameless.select("text").mapInPandas(whole, "n long, kept binary").select(F.lit(None).cast("long").alias("doc_id"), "n", F.array().cast("array<long>").alias("edges"), "kept")
    spans = F.expr("transform(sequence(1, cast(size(edges) / 2 as int)), i -> struct(edges[2 * i - 2] as start, edges[2 * i - 1] as end))")
    return named.unionByName(others).select("doc_id", "n", F.when(F.size("edges") > 0, spans).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"), "kept")


def edges_of(gone: np.ndarray) -> list[int]:
    """Start and end of every run of true values, one after another."""
    return np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist() if gone.any() else []


def digest(removed: DataFrame, n: str) -> DataFrame:
    """doc_id, n under its name, n_removed, n_spans and kept_sha256."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return removed.select("doc_id", F.col("n").alias(n), lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
