"""Secret scans, judged by corpus-wide ownership.

Every candidate value of the whole corpus is hashed and counted by distinct repositories and distinct owners.
A value held by at least ``EXAMPLE_OWNERS`` owners is a widely copied example; one that fewer hold looks live.
The base kinds (assign, access, hex) are always reported. The method adds spans of kind ``opaque``: long mixed
letter-digit runs that no base span covers and that look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The kinds in their order, with pattern, group that holds the value, and least length of it.
#: The pattern of opaque matches whole runs; those without a letter or without a digit are left out afterwards.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
EXAMPLE_OWNERS = 3


SPANS = "array<struct<start: int, place: int, kind: string, end: int, value: string>>"
RUN = 256  # matches that are laid out in one go


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches of one kind: struct(start, place of the kind, kind, end, value) in code points, end exclusive.

    Spark has no function for match positions. Splitting at the same matches gives the gaps between them, so a
    match starts after all earlier gaps and matches. Matches are added up in runs, so that a text of a hundred
    thousand of them copies no array as often.
    """
    order = [k for k, *_ in KINDS].index(kind)
    lit = F.lit(pattern)
    whole, value, gaps = F.regexp_extract_all(text, lit, F.lit(0)), F.regexp_extract_all(text, lit, F.lit(group)), F.split(text, pattern)
    none = F.array().cast(SPANS)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda i: F.slice(rows, i * RUN + 1, F.lit(RUN)))

    def add(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(order).alias("place"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def add_run(acc, run):
        own = F.aggregate(run, F.struct(acc["at"].alias("at"), none.alias("spans")), add)
        return F.struct(own["at"].alias("at"), F.concat(acc["spans"], own["spans"]).alias("spans"))

    spans = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("spans")), add_run, lambda acc: acc["spans"])
    fits = lambda v: (F.char_length(v) >= least) & (F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[A-Za-z]")) if kind == "opaque" else F.lit(True))
    return F.when(F.rlike(text, lit), F.filter(spans, lambda s: fits(s["value"]))).otherwise(none)


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """Per row: repo, owner, two hashes of the text (null: empty), and the spans of the base kinds and of opaque runs beside them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.col(repo).alias("repo"), F.col(owner).cast("string").alias("owner"), *[h.alias(n) for n, h in text_keys(text).items()], text.alias("text"))
    kinds = [found(F.col("text"), *k) for k in KINDS]
    out = out.withColumn("base", F.array_sort(F.concat(*kinds[:-1]))).withColumn("opaque", kinds[-1]).drop("text")
    beside = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return out.withColumn("more", beside).drop("opaque")


def text_keys(text: Column) -> dict[str, Column]:
    """128 bits that stand for a text in joins, so that texts stay where they are."""
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("2"), text)}


def ownership(found_in: DataFrame) -> DataFrame:
    """Per hash of a value the numbers of distinct repositories and owners that hold it; nulls are one of each."""
    each = found_in.select(F.explode(F.concat("base", "more")).alias("s"), "owner", "repo").select(F.sha2(F.col("s.value"), 256).alias("hash"), "owner", F.col("repo").cast("string").alias("repo"))
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> tuple[DataFrame, DataFrame]:
    """What every row holds (repo, owner, k1, k2, base), and the verdict on each distinct text with candidates.

    The verdict has k1, k2 (``text_keys``), all (base spans and live opaque ones), live (what looks live of both) and
    the numbers n_live and n_example of base values. Null and empty texts hold nothing. Values are compared by
    SHA-256. Every text is searched once; only spans travel. A value that many documents hold is counted per
    (hash, owner, repository) first, so no task gathers its documents. Repeated rows are one repository; no rows
    give no rows.
    """
    held = cut(candidates(docs, owner, repo))
    some = held.where(F.size("base") + F.size("more") > 0)
    each = some.groupBy("k1", "k2").agg(F.first("base").alias("base"), F.first("more").alias("more"))
    spans = each.select("k1", "k2", F.explode(F.concat("base", "more")).alias("s")).withColumn("hash", F.sha2(F.col("s.value"), 256))
    judged = spans.join(ownership(some), "hash").withColumn("example", F.col("owners") >= example_owners).withColumn("basic", F.col("s.kind") != "opaque")
    verdict = judged.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_list(F.when(~F.col("example") | F.col("basic"), F.col("s")))).alias("all"),
        F.array_sort(F.collect_list(F.when(~F.col("example"), F.col("s")))).alias("live"),
        F.count(F.when(~F.col("example") & F.col("basic"), 1)).alias("n_live"),
        F.count(F.when(F.col("example") & F.col("basic"), 1)).alias("n_example"),
    )
    return held, cut(verdict)


def report(docs: DataFrame) -> DataFrame:
    """The digest of every document's spans, by row."""
    held, verdict = scan(docs)
    got = held.join(verdict, ["k1", "k2"], "left")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        F.col("repo").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every live-looking span replaced by ``mark``, overlapping spans by one; n_chars follows the text.

    Widely copied examples stay. Columns may have any name. Texts are not searched again but joined to the verdict
    on their hash; the verdict has a row for each text with candidates, and Spark broadcasts it when its size allows.
    """
    _, verdict = scan(docs)
    live = verdict.where(F.size("live") > 0).select(F.struct("k1", "k2").alias("key"), "live")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*[h.alias(n) for n, h in text_keys(F.coalesce(F.col("text"), F.lit(""))).items()]).alias("key"))
    got = rows.join(live, "key", "left")
    text = F.col("row.text")
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    clean = F.aggregate("live", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    out = got.select("row", F.when(F.col("live").isNotNull(), clean).alias("clean"))
    kind = dict(docs.dtypes)
    made = {"text": F.coalesce("clean", text), "n_chars": F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(kind.get("n_chars", "long"))).otherwise(F.col("row.n_chars")) if "n_chars" in kind else None}
    return out.select(*[(made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
