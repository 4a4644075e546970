"""Quality rules: counts over each whole text, then a hashed n-gram likelihood ratio.

Two multinomials over ``BUCKETS`` hashed word uni- and bigrams are counted: one over all documents, one over a
trusted target. An n-gram's weight is log p_target - log p_raw, with ``PRIOR`` counts of the raw distribution in
both; weights down to -``SLACK`` are counting noise and stand for 0. A document's score is the mean over its n-grams
of what lies below that, so 0 at best, and few words that trusted texts never use lower it. A document is kept if no
base rule fails and its score reaches a threshold. No randomness: equal texts get equal verdicts.

The raw counts cover every document and the target every trusted one: those that a label calls good (quality 1,
toxic 0). A fifth of them (crc32 of the id mod 5 is 0) is held out of the target; the threshold is the ``LOSS``
quantile of the scores of all of these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, words_of

BUCKETS = 65_536
FEW = 1_000_000  # ids that may be broadcast
BINS = 4096  # of one round of a quantile
PRIOR = 2.0
SLACK = 0.7
LOSS = 0.02


def buckets(words: str, size: int = BUCKETS) -> tuple[Column, Column]:
    """The buckets of every word and of every word with its successor, as two arrays.

    Words fall into the even buckets and pairs into the odd ones; the last word's pair is the word and no other.
    """
    one = F.expr(f"transform({words}, x -> cast(2 * pmod(xxhash64(x), {size // 2}) as int))")
    two = F.expr(f"transform({words}, (x, i) -> cast(2 * pmod(xxhash64(x, get({words}, i + 1)), {size // 2}) + 1 as int))")
    return one, two


def trusted_ids(labels: DataFrame, calibration: bool = False) -> DataFrame:
    """All ids of the kind, each once; counted, and broadcast only if they are few."""
    held = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5) == 0
    good = cut(labels.where("quality = 1 and toxic = 0 and doc_id is not null").where(held if calibration else ~held).select("doc_id").distinct())
    return F.broadcast(good) if good.count() <= FEW else good


def weights(docs: DataFrame, labels: DataFrame, size: int = BUCKETS) -> list[float]:
    """What each bucket adds to a score, 0 or less; ``size`` numbers at any scale.

    Without trusted documents every weight is 0, so only the base rules decide.
    """
    one, two = buckets("w", size)
    marked = docs.select("doc_id", "text").join(trusted_ids(labels).withColumn("_good", F.lit(1)), "doc_id", "left")
    grams = marked.select("_good", words_of(F.col("text")).alias("w")).select("_good", F.concat(one, two).alias("b"))
    # explode_outer: for explode the optimizer adds a size filter and copies the whole word expression into it.
    counts = grams.select("_good", F.explode_outer("b").alias("b")).where("b is not null").groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good"))
    found = counts.toPandas()  # at most ``size`` rows
    share = float(found["good"].sum()) / max(1.0, float(found["raw"].sum()))
    out = [0.0] * size
    for b, raw, good in zip(found["b"].tolist(), found["raw"].tolist(), found["good"].tolist(), strict=True):
        if share > 0:
            out[b] = min(0.0, math.log((good + PRIOR) / (share * raw + PRIOR)) + SLACK)
    return out


def threshold_of(docs: DataFrame, labels: DataFrame, weighed: list[float], loss: float = LOSS) -> float:
    """The score that all but a share ``loss`` of the calibration rows reach; without such rows no score is too low."""
    held = docs.join(trusted_ids(labels, calibration=True), "doc_id", "left_semi").select("doc_id", "text")
    # The rule is a value and no filter: the optimizer would push a filter down and copy the word expressions into it.
    each = judge(held, weighed, -math.inf).groupBy("doc_id").agg(F.min(F.when(~F.col("base_failed"), F.col("score"))).alias("score"))
    return kth_score(cut(each.select("score")).where("score is not null"), loss)


def kth_score(scores: DataFrame, loss: float) -> float:
    """Of n sorted scores the one at place int(n * loss), exactly: counts in ``BINS`` bins narrow the range down, so at
    most that many rows reach the driver in a round, however many scores there are."""
    n, low, high = scores.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    if not n:
        return -math.inf
    k = int(n * loss)
    while low < high:
        width = (high - low) / BINS
        inside = scores.where((F.col("score") >= low) & (F.col("score") <= high))
        place = F.least(F.lit(BINS - 1), F.floor((F.col("score") - low) / width)) if width > 0 else F.lit(0)
        bins = sorted(inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect())
        if len(bins) == 1 and width == 0:
            break
        for r in bins:
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def score(docs: DataFrame, labels: DataFrame, size: int = BUCKETS) -> DataFrame:
    """Counts, rules and verdict of every row of docs (doc_id, text); other columns are ignored.

    Null and blank texts have no words: all counts 0, score 0, and the length rule fails them. Repeated rows are
    judged alike, each by itself; a repeated id of a trusted document counts each of its texts as trusted. Texts are
    judged to their end. No rows give no rows. Without labels only the base rules decide.
    """
    weighed = weights(docs, labels, size)
    return judge(docs, weighed, threshold_of(docs, labels, weighed))


def judge(docs: DataFrame, weighed: list[float], threshold: float) -> DataFrame:
    """The verdict by given weights. The trigram counts are exact up to collisions of 64-bit hashes inside one text."""
    size = len(weighed)
    llr = F.expr("cast(split('" + ",".join(f"{x:.6g}" for x in weighed) + "', ',') as array<double>)")
    one, two = buckets("_w", size)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    base = docs.select("doc_id", words_of(F.col("text")).alias("_w"), F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("_lines"))
    base = base.select(
        "doc_id", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(_w) < 4, array(), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))").cast("array<bigint>").alias("_h"),
        one.alias("_one"), two.alias("_two"),
    )
    # Windows that occur twice: sorted with their places, they have an equal neighbour.
    base = base.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(_h, (h, i) -> struct(h, i))))"))
    at = "transform(filter(sequence(0, size(_s) - 1), j -> _s[j].h = get(_s, j - 1).h or _s[j].h = get(_s, j + 1).h), j -> _s[j].i)"
    base = base.withColumn("_at", F.expr(f"if(size(_s) = 0, cast(array() as array<int>), sort_array({at}))"))
    repeats = F.expr("aggregate(_at, struct(0L as n, -3 as last), (a, i) -> struct(a.n + least(3, i - a.last) as n, i as last), a -> a.n)")
    total = F.aggregate("_two", F.aggregate("_one", F.lit(0.0), lambda acc, b: acc + F.get(llr, b)), lambda acc, b: acc + F.get(llr, b))
    out = base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"),
        F.when(F.size("_one") > 0, total / (2 * F.size("_one"))).otherwise(F.lit(0.0)).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
