"""Packing by lexical retrieval.

Documents are tokenized where they are read. Their two highest token ids, in a vocabulary learned by merges the
rarest, are their place in a lexical order of all documents, which is cut into shards of about ``SHARD_TOKENS``
tokens; so documents that share a rare token meet in one shard, wherever they were read. A token that leads more than
a shard holds spreads over several by a hash of the row's place, so that equal rows spread too. Each shard has a BM25 inverted index over token ids. The first unused
document of a shard seeds a window; the unused documents that score highest for the seed fill it. A document that
does not fit is cut, and what is left of it opens the next window as its seed. Every window is full but for the last
of a shard, which is laid out in sequences of powers of two, so nothing is padded.

Token ids are written once to the shared checkpoint folder and dealt by shard once; memory is bounded by a shard and
one batch. The counts that reach the driver have one row per vocabulary entry, whatever the input.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, to_arrow

WINDOW = 4096
END = 2
SHARD_TOKENS = 1_000_000
TASK_SHARDS = 3  # shards that a task lays out one after another, about
MEMO = 600_000
K1, B = 1.2, 0.75
VOCABULARY = "word_bpe_49k.json"
#: Fixed value: the word pattern of that vocabulary's pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: what that vocabulary appends to the last token of a piece.
WORD_END = "</w>"
PLAIN = 0x250  # code points below it mean the same to Python's lower-casing and patterns as to the tokenizer


def narrow_pieces() -> re.Pattern:
    """PIECES with its classes spelled out for characters below PLAIN and their lower case."""
    known = sorted({x for c in map(chr, range(PLAIN)) for x in c + c.lower()})
    letters, digits = ("".join(x for x in known if unicodedata.category(x)[0] == kind) for kind in "LN")
    return re.compile(PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r\x20\x85\xa0{letters}{digits}]").replace(r"\p{L}", letters).replace(r"\p{N}", digits))


class Encoder:
    """Token ids of whole texts, by the tokenizer; pieces seen before come from a bounded memo.

    The tokenizer cuts a text into pieces that it encodes one by one, so ids of pieces can be kept. New pieces go
    to it many at a time with spaces between them, and their ids are told apart by the ends of words. That way is
    taken for texts of characters below U+0250 without special tokens, U+0130 or U+001C to U+001F; all others go
    to the tokenizer whole. The memo numbers the pieces; ``tokens``, ``starts`` and ``sizes`` hold their ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pieces = narrow_pieces()
        self.plain = re.compile(r"[\x00-\x1b\x20-\u012f\u0131-\u024f]*")
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for token, i in self.whole.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.tokens, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has."""
        ids = np.array(self.whole.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(pieces):
            return ids, np.diff(ends, prepend=0)
        each = [e.ids for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]  # no ends of words: one by one
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Puts the ids of new pieces into the memo."""
        new, sizes = zip(*[self.encoded(pieces[i : i + 512]) for i in range(0, len(pieces), 512)], strict=True)
        sizes = np.concatenate(sizes)
        self.starts = np.concatenate((self.starts, len(self.tokens) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.tokens = np.concatenate((self.tokens, *new))
        self.memo.update(zip(pieces, range(len(self.memo), len(self.memo) + len(pieces)), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.plain.fullmatch(t) is not None and "<|" not in t for t in texts]
        if len(self.memo) > MEMO:
            self.forget()
        cut = [self.pieces.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p]
        sizes = np.array([len(c) for c in cut], np.int64)
        at = np.fromiter(map(self.memo.get, chain.from_iterable(cut), repeat(-1)), np.int64, int(sizes.sum()))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            flat = list(chain.from_iterable(cut))
            unknown = [flat[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(unknown)))
            at[missing] = [self.memo[w] for w in unknown]
        n = self.sizes[at]
        ends = np.cumsum(n)
        ids = self.tokens[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[np.cumsum(sizes)]
        known = iter(np.split(ids, bounds[:-1])) if len(sizes) else iter(())
        direct = iter(self.whole.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [next(known) if p else np.array(next(direct).ids, np.uint32) for p in plain]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Index:
    """BM25 postings of one shard: for each token the documents that hold it and what it adds to their score."""

    def __init__(self, docs: list[np.ndarray]):
        size = np.array([len(d) for d in docs], np.int64)
        held, tf = np.unique(np.repeat(np.arange(len(docs)) << 32, size) | np.concatenate(docs), return_counts=True)
        owner, terms = held >> 32, held & 0xFFFFFFFF
        self.terms = np.split(terms, np.searchsorted(owner, np.arange(1, len(docs))))
        order = np.argsort(terms, kind="stable")
        self.owner, tf, terms = owner[order].astype(np.int32), tf[order], terms[order]
        self.vocabulary, start, df = np.unique(terms, return_index=True, return_counts=True)
        self.start, self.end = start, start + df
        idf = np.repeat(np.log1p((len(docs) - df + 0.5) / (df + 0.5)), df)
        norm = K1 * (1 - B + B * size[self.owner] / max(1.0, size.mean()))
        self.weight = idf * tf * (K1 + 1) / (tf + norm)
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        starts, sizes = self.start[at], self.end[at] - self.start[at]
        rows = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return np.bincount(self.owner[rows], self.weight[rows], self.n)


def arrange(docs: list[np.ndarray], window: int = WINDOW) -> list[int]:
    """The order in which the documents follow one another: seed, its best unused neighbours, the next seed."""
    index, unused, order = Index(docs), np.ones(len(docs), bool), []
    room, seed, following = 0, -1, 0
    while len(order) < len(docs):
        if room == 0:
            while not unused[following]:
                following += 1
            seed, room = following, window
            unused[seed] = False
            order.append(seed)
            room -= len(docs[seed])
        while room < 0:  # the rest of a cut document opens further windows and is the seed
            seed = order[-1]
            room += window
        if room > 0 and unused.any():
            rank = np.where(unused, index.scores(seed), -1.0)
            for d in np.argsort(-rank, kind="stable"):
                if not unused[d]:
                    break
                unused[d] = False
                order.append(int(d))
                room -= len(docs[d])
                if room <= 0:
                    break
    return order


def sequences(total: int, window: int = WINDOW) -> list[int]:
    """Ends of the sequences of a stream of that many tokens: full windows, then powers of two, largest first."""
    ends = list(range(window, total + 1, window))
    at, rest = (ends[-1] if ends else 0), total % window
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


PIECE = (("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()))


def lay_out(docs: list[np.ndarray], first: int, window: int = WINDOW) -> tuple[list[tuple], int]:
    """The pieces (PIECE) of one shard, rows being places in docs, and the number of its sequences."""
    order = arrange(docs, window)
    starts = np.concatenate(([0], np.cumsum([len(docs[d]) for d in order])))
    ends = sequences(int(starts[-1]), window)
    begin = [0, *ends[:-1]]
    rows, s = [], 0
    for d, (lo, hi) in zip(order, pairwise(starts.tolist()), strict=True):
        at = lo
        while at < hi:
            while ends[s] <= at:
                s += 1
            to = min(hi, ends[s])
            rows.append((d, at - lo, to - at, hi - lo, first + s, at - begin[s], docs[d][at - lo : to - lo].astype("<u4").tobytes()))
            at = to
    return rows, len(ends)


def tokenized(docs: DataFrame, path: str | None) -> DataFrame:
    """doc_id, tokens (ids with the end token, little-endian,), n, and the two highest ids."""
    docs = docs.select("doc_id", "text")
    code = token_code(path)

    def run(batches):
        encode, end = encoder(path), np.array([END], np.uint32)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = encode([t or "" for t in part.column(1).to_pylist()])
                flat = np.concatenate([x for g in ids for x in (g, end)])
                n = np.array([len(g) + 1 for g in ids], np.int64)
                starts = np.cumsum(n) - n
                lead = np.maximum.reduceat(flat, starts)
                second = np.maximum.reduceat(np.where(flat == np.repeat(lead, n), 0, flat), starts)
                bounds = np.append(starts, len(flat)).astype(np.int32) * np.dtype(code).itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(flat.astype(code).tobytes())])
                made = [packed, *[pa.array(x.astype(np.int64)) for x in (n, lead, second)]]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["doc_id", "tokens", "n", "lead", "second"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens binary, n long, lead long, second long")


def token_code(path: str | None) -> str:
    """How tokens are stored on the way: two bytes where the vocabulary allows."""
    return "<u2" if encoder(path).whole.get_vocab_size() <= 1 << 16 else "<u4"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and ids (little-endian, 32 bits).

    Null and empty texts are the end token alone. Repeated rows are packed as often as they occur. Ids may be null.
    Texts are tokenized whole and cut freely. Sequence numbers hold the shard in their upper bits. Other columns are
    ignored, whatever their names; no rows give no rows. ``path`` is the vocabulary file; by default the public one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    code = token_code(path)
    rows = cut(tokenized(docs, path))
    counts = rows.groupBy("lead").agg(F.sum("n").alias("n")).orderBy("lead").collect()  # a row per token id at most
    table, at = [], 0
    for r in counts:
        table.append((r["lead"], at // shard_tokens, max(1, -(-r["n"] // shard_tokens))))
        at += r["n"]
    shards = spark.createDataFrame(table, "lead long, first long, span long")
    width = max(1, min(at // (TASK_SHARDS * shard_tokens) + 1, 20_000))
    spread = F.col("first") + F.when(F.col("span") > 1, F.pmod(F.xxhash64("second", F.monotonically_increasing_id()), F.col("span"))).otherwise(0)
    dealt = rows.join(F.broadcast(shards), "lead").withColumn("shard", spread).select("shard", "lead", "second", "doc_id", "tokens")
    dealt = dealt.repartition(width, "shard").sortWithinPartitions("shard", "lead", "second", F.xxhash64("tokens"), "doc_id")
    id_type = to_arrow(docs.schema["doc_id"].dataType)

    def run(batches):
        _encoders.clear()  # a worker that has tokenized before would keep its memo beside the index
        ids, held, tokens, shard, first = [], [], 0, None, 0

        def emit():
            nonlocal ids, held, tokens, first
            if held:
                got, n = lay_out(held, first, window)
                first += n
                keys = pa.concat_arrays(ids)
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*got, strict=True), PIECE, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(columns[0]), *columns[1:]], names=["doc_id", *[n for n, _ in PIECE[1:]]])
            ids, held, tokens = [], [], 0

        for batch in batches:
            of = np.array(batch.column(0).to_pylist(), np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)])) if len(of) else [0]
            for lo, hi in pairwise(edges):
                if of[lo] != shard:
                    yield from emit()
                    shard, first = int(of[lo]), int(of[lo]) << 24
                for a in range(lo, hi, 1024):
                    part = batch.slice(a, min(1024, hi - a))
                    ids.append(part.column(1).cast(id_type))
                    for raw in part.column(2).to_pylist():
                        held.append(np.frombuffer(raw, code).astype(np.uint32))
                        tokens += len(held[-1])
                    if tokens >= 2 * shard_tokens:
                        yield from emit()
        yield from emit()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.select("shard", "doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def report(docs: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of these."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
