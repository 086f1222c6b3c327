"""Quality rules: counts of words, symbols and repeats, and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` hashed n-grams (single tokens and pairs; tokens are runs of letters and digits or
runs of marks) are counted: one over the trusted documents, those that ``labels`` marks as of good quality, one over
every document. A document's score is the mean log ratio of the two over its n-grams, so that length doesn't matter,
and every document is held against the same threshold. A pair of equal tokens has one n-gram of its own, whatever the
token, since stuttering texts differ in their words only.

All of it is DataFrame expressions. The counts are BUCKETS rows whatever the corpus holds; they are turned into weights
that stand in the plan as one constant array.

Defined results: null and empty texts have no words and fail the base rule; a text without n-grams scores 0; with no
trusted documents every score is 0; repeated rows count each; labels of null id are ignored; texts of any length are
read whole; nothing is ordered, so that there are no ties; an empty table gives an empty one; other columns are ignored
or, by ``keep_good``, carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BUCKETS = 16_384
HALF = BUCKETS // 2
#: N-grams added to each bucket at the overall share of trusted ones, which draws buckets with few towards ratio 1.
SMOOTHING = 10.0
THRESHOLD = -0.1
#: Ids of trusted documents are broadcast up to this many.
BROADCAST_IDS = 2_000_000
SPACE = r"[\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words within windows of ``width`` words that the array holds twice or more, the first included."""

    def covered(at: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(at) - 1)
        return F.aggregate(steps, F.lit(width).cast("long"), lambda acc, i: acc + F.least(F.lit(width), F.element_at(at, i + 1) - F.element_at(at, i)))

    def places(s: Column) -> Column:
        same = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False)))
        return F.array_sort(F.transform(same, lambda e: e["i"]))

    def of_windows(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(let(ranked, places), covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), of_windows))


def n_grams(text: Column) -> Column:
    """Buckets of a text's tokens (below HALF) and of its token pairs (from HALF; HALF itself: equal pairs)."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: x.bitwiseAND(HALF - 1).cast("int"))
        pairs = F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))),
            F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))),
            lambda a, b: F.when(a == b, F.lit(HALF)).otherwise(HALF + 1 + F.pmod(F.xxhash64(a, b), F.lit(HALF - 1)).cast("int")),
        )
        return F.concat(one, pairs)

    return let(hashes, both)


def weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log ratio of each bucket, from every document; three decimals."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("t")).distinct()
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    marked = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("t"), "left")
    grams = marked.select(F.col("t").isNotNull().cast("int").alias("good"), F.explode(n_grams(F.coalesce("text", F.lit("")))).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()  # BUCKETS rows at most
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    if not sum(good):
        return [0.0] * BUCKETS
    share = sum(good) / sum(raw)
    return [round(log((g + SMOOTHING * share) / ((r + SMOOTHING) * share)), 3) for r, g in zip(raw, good, strict=True)]


def score(text: Column, table: list[float]) -> Column:
    """Mean weight of the text's n-grams."""
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded to one array
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(constant, b))
    return let(n_grams(text), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total(g) / F.size(g)))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one more column, a struct ``quality``: the counts, base_failed, score and kept."""
    table = weights(docs, labels)
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality"]
    own = {c: fresh(docs, c) for c in ("words", "lines", "text", "n", "chars", "symbols", "dup", "rep", "score")}
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(*others, words.alias(own["words"]), lines.alias(own["lines"]), text.alias(own["text"]))
    counts = first.select(
        *others,
        F.size(own["words"]).cast("long").alias(own["n"]),
        F.length(F.array_join(own["words"], "")).cast("long").alias(own["chars"]),
        F.regexp_count(own["text"], F.lit(r"[#*$%&|<>]")).cast("long").alias(own["symbols"]),
        (F.size(own["lines"]) - F.size(F.array_distinct(own["lines"]))).cast("long").alias(own["dup"]),
        repeated_words(F.col(own["words"])).cast("long").alias(own["rep"]),
        score(F.col(own["text"]), table).alias(own["score"]),
    )
    failed = (F.col(own["n"]) < 20) | (100 * F.col(own["rep"]) > 30 * F.col(own["n"]))
    quality = F.struct(
        F.col(own["n"]).alias("n_words"),
        F.col(own["chars"]).alias("word_chars"),
        F.col(own["symbols"]).alias("n_symbols"),
        F.col(own["dup"]).alias("n_dup_lines"),
        F.col(own["rep"]).alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col(own["score"]).alias("score"),
        (~failed & (F.col(own["score"]) >= threshold)).alias("kept"),
    )
    return counts.select(*others, quality.alias("quality"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of ``op3``."""
    found = judged(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", *(F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, every column as it was."""
    own = {c: fresh(docs, c) for c in docs.columns if c.lower() == "quality"}
    narrow = docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns])
    kept = judged(narrow, labels).where("quality.kept")
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
