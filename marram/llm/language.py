"""Language identification with a byte convolutional network, trained here in numpy.

Texts are cut into fixed windows of ``WINDOW`` bytes, all of them, to the last. Filters of several widths slide over
the bytes of a window; the maximum of each filter over the window feeds a softmax. Inputs are one-hot bytes, so a
filter is a table of 256 rows for each of its offsets, and convolving is adding looked-up rows. A text's class is
that of the mean logits of its windows, weighted by their bytes.

The network is fitted on the driver on at most ``SAMPLE`` labelled rows, an equal share of each of at most
``CLASSES`` languages (smallest hashes of the id), and on ``VIEWS`` windows of each at hashed places of the whole
text; it has some ten thousand numbers at any scale and travels inside the function.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, by_text, short_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE = 2_000
CLASSES = 256  # languages, the most frequent ones, that can be learned
VIEWS = 4
EPOCHS = 8
CHUNK = 512  # windows scored at a time


class Net:
    """Filters, then one dense layer. ``tables[w][j]`` is (256, FILTERS): what byte b at offset j adds."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.offset = np.zeros(len(classes), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False):
        """Maximum of each filter over each window of x (n, WINDOW), and where it is."""
        tops, at = [], []
        for width, table in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - width + 1
            out = table[0].take(x[:, :n], axis=0)
            for j in range(1, width):
                out += table[j].take(x[:, j : j + n], axis=0)
            tops.append(out.max(axis=1))
            if places:
                at.append(out.argmax(axis=1))
        return np.concatenate(tops, axis=1) + self.bias, at

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(x)[0], 0) @ self.dense + self.offset

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Net:
        """Adam on the cross entropy; the same data give the same network."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.dense, self.offset]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                z, at = self.pooled(xb, True)
                a = np.maximum(z, 0)
                p = softmax(a @ self.dense + self.offset)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dz = (p @ self.dense.T) * (z > 0)
                grads = []
                for k, width in enumerate(WIDTHS):
                    g, part = np.zeros_like(self.tables[k]), dz[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        b = np.take_along_axis(xb, at[k] + j, axis=1)
                        np.add.at(g[j], (b, np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [dz.sum(0), a.T @ p, p.sum(0)]
                t += 1
                for v, g, a1, a2 in zip(params, grads, m1, m2, strict=True):
                    a1 += 0.1 * (g - a1)
                    a2 += 0.001 * (g * g - a2)
                    v -= rate * (a1 / (1 - 0.9**t)) / (np.sqrt(a2 / (1 - 0.999**t)) + 1e-8)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def windows(data: bytes) -> np.ndarray:
    """The bytes as rows of WINDOW, the last one padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Net | None:
    """A network from a bounded sample of the rows with text and label; None if there are none.

    Ties of the hash go by id and text, so equal tables give equal networks; repeated rows are examples as often.
    """
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(CLASSES).collect()
    if not counts:
        return None
    quota = max(1, sample // len(counts))
    # Only hashes below the one that twice the quota is expected to reach are ranked, so few texts move at any size.
    bound = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(2**63 - 1, int(2**64 * (2 * quota + 20) / r["count"]) - 2**63))])
    views = F.array(*[F.substring("t", F.lit(1) + F.pmod(F.xxhash64("i", F.lit(k)), F.greatest(F.lit(1), F.char_length("t") - WINDOW)).cast("int"), F.lit(WINDOW)) for k in range(VIEWS)])
    few = labelled.where(F.xxhash64("i") <= bound[F.col("l")]).select("i", "l", F.array_distinct(views).alias("v"))
    first = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", "v")
    rows = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= quota).select("l", "v").orderBy("l", "v").collect()
    pairs = [(r["l"], v) for r in rows for v in r["v"] if any(c.isalpha() for c in v)]
    if not pairs:
        return None
    classes = sorted({lang for lang, _ in pairs})
    xs = [windows(v.encode("utf-8", "replace")[:WINDOW]) for _, v in pairs]
    y = np.array([classes.index(lang) for lang, _ in pairs])
    return Net(classes).fit(np.concatenate(xs), y)


def identify(texts: list[str | None], net: Net | None) -> tuple[list[str], list[float]]:
    """Class and score of each text; ``und`` and 0 for null, for a text without a letter, or without a network."""
    if net is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums, weight = np.zeros((len(texts), len(net.classes))), np.zeros(len(texts))
    held, rows, owner = [], 0, []

    def flush() -> None:
        if held:
            x = np.concatenate(held)
            who = np.repeat(*map(np.array, zip(*owner, strict=True)))
            n = (x != 0).sum(axis=1) + 1e-9
            np.add.at(sums, who, net.logits(x).astype(np.float64) * n[:, None])
            np.add.at(weight, who, n)
            held.clear()
            owner.clear()

    for i, text in enumerate(texts):
        if not text or not any(c.isalpha() for c in text):
            continue
        x = windows(text.encode("utf-8", "replace"))
        for a in range(0, len(x), CHUNK):
            held.append(x[a : a + CHUNK])
            owner.append((i, len(held[-1])))
            rows += len(held[-1])
            if rows >= CHUNK:
                flush()
                rows = 0
    flush()
    known = weight > 0
    p = softmax(sums / np.where(known, weight, 1)[:, None])
    best = p.argmax(axis=1)
    return [net.classes[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang_pred and score of every row. One Arrow batch of rows is in memory at a time.

    Null, empty and letterless texts are ``und`` with score 0. Long texts are read to the last byte. Repeated rows
    are rows. No rows give no rows. Other columns are ignored.
    """
    return by_text(docs, lambda texts: list(identify(texts, net)), "lang_pred string, score double")


def held_out():
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce((F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5) == 0, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """Predictions for every document, learned from those that are not held out."""
    return predict(docs, train(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows, with their columns, whose language is found with a score of at least ``least``.

    Learns from the text and label of all rows but the held-out ones; without labels every text with a letter stays.
    Null, letterless and undecided texts go. Columns may have any name and type: rows are filtered in Arrow, as they
    are.
    """
    net = train(docs.where(~held_out()))
    if net is None:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    at = docs.columns.index("text")
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, whole.num_rows, SLICE)):
            langs, scores = identify(batch.column(at).to_pylist(), net)
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
