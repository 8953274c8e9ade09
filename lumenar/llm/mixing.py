"""Mixing sources to target shares of all tokens, with a cap on repetitions.

Shares are reached by capped water-filling: a source whose share would need more than
``max_repeats`` passes over its documents is clamped there, and what it leaves is spread over the
others in proportion until nothing is clamped anew. The total is the number of tokens of all
documents of the targeted sources, if none is given; ``exact_total`` is the largest total at which
no source is clamped. Each source then repeats all its documents a whole number of times, and a
seeded part of them once more.

The part is cut exactly, without sorting a source in one task: documents are hashed into buckets,
the buckets' token sums decide which bucket holds the cut, that bucket is split in the same way, and
only what is left, one document in 16 million, is ordered.

Defined results: documents of a source without a target, or without a source, are not used;
documents without tokens are not used; a target whose source has no tokens gets nothing, and its
share goes to the others; ties of the hash are ordered by the key; repeated rows count each;
targets are rescaled to sum to 1; null or negative targets count as 0 and null caps as 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass(frozen=True)
class Share:
    """What one source gives: ``whole`` passes, and ``part`` tokens of one more."""

    source: str
    target: float
    available: int
    max_repeats: int
    tokens: float

    @property
    def whole(self) -> int:
        return min(int(self.tokens / self.available + 1e-12), self.max_repeats) if self.available else 0

    @property
    def part(self) -> float:
        return max(0.0, self.tokens - self.whole * self.available) if self.whole < self.max_repeats else 0.0

    @property
    def clamped(self) -> bool:
        return self.target > 0 and 0 < self.available * self.max_repeats <= self.tokens


def water_fill(sources: list[tuple[str, float, int, int]], total: float | None = None) -> list[Share]:
    """Tokens of each (source, target, available, max_repeats); the total is all that is available unless given."""
    live = {s: (max(t or 0.0, 0.0), a, max(r, 0)) for s, t, a, r in sources}
    weight = {s: t for s, (t, a, r) in live.items() if t > 0 and a * r > 0}
    cap = {s: live[s][1] * live[s][2] for s in weight}
    given = dict.fromkeys(live, 0.0)
    if weight:
        if total is None:
            total = sum(live[s][1] for s in weight)
        left, open_ = float(total), dict(weight)
        while open_ and left > 0:
            scale = sum(open_.values())
            over = [s for s, w in open_.items() if left * w / scale > cap[s] * (1 + 1e-12)]
            if not over:
                for s, w in open_.items():
                    given[s] = min(left * w / scale, cap[s])
                break
            for s in over:
                given[s] = float(cap[s])
                left -= cap[s]
                del open_[s]
    return [Share(s, live[s][0], live[s][1], live[s][2], given[s]) for s in sorted(live)]


def exact_total(sources: list[tuple[str, float, int, int]]) -> float:
    """The largest total at which every source with documents reaches its share of it without being clamped."""
    live = [(t, a * max(r, 0)) for _, t, a, r in sources if (t or 0) > 0 and a * r > 0]
    scale = sum(t for t, _ in live)
    return min((cap * scale / t for t, cap in live), default=0.0)


def plan_shares(sized: DataFrame, targets: DataFrame, total: float | str | None = None) -> list[Share]:
    """The shares for ``sized`` (``source, n_tokens``): what reaches the driver is a row per target.

    ``total`` may be ``"exact"`` for ``exact_total``.
    """
    goals = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target"), F.max("max_repeats").alias("repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = goals.join(have, "source", "left").collect()
    sources = [(r.source, r.target, int(r.available or 0), 1 if r.repeats is None else r.repeats) for r in rows]
    return water_fill(sources, exact_total(sources) if total == "exact" else total)


def mix_sources(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | str | None = None, seed: int = 17) -> DataFrame:
    """``key, source, n_tokens, repeats``: the documents of the mix and how often each is used.

    ``sized`` has ``key, source, n_tokens`` and is read four times; cut its lineage first.
    """
    spark = sized.sparkSession
    sized = sized.select(key, "source", "n_tokens")
    rows = [(s.source, s.whole, float(s.part)) for s in plan_shares(sized, targets, total) if s.tokens > 0]
    shares = spark.createDataFrame(rows, "source string, whole int, part double")
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    levels = {f"bucket{k}": F.pmod(F.shiftrightunsigned(hashed, 24 * k), F.lit(BUCKETS)).cast("int") for k in (0, 1)}
    docs = sized.filter("n_tokens > 0").join(shares, "source").withColumns(levels)
    # of each source the bucket in which its part ends, and in that bucket the same again
    first = _cuts(docs.filter("part > 0").withColumn("before", F.lit(0).cast("bigint")), "bucket0", "cut0")
    placed = docs.join(first, "source", "left")
    second = _cuts(placed.filter("bucket0 = cut0"), "bucket1", "cut1").withColumnRenamed("before", "sofar")
    placed = placed.drop("before").join(second, "source", "left")
    on_edge = F.coalesce((F.col("bucket0") == F.col("cut0")) & (F.col("bucket1") == F.col("cut1")), F.lit(False))
    inside = (F.col("bucket0") < F.col("cut0")) | (F.col("bucket0") == F.col("cut0")) & (F.col("bucket1") < F.col("cut1"))
    clear = placed.filter(~on_edge).withColumn("more", F.coalesce(inside, F.lit(False)).cast("int"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter(on_edge).withColumn("sofar", F.col("sofar") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    edge = edge.withColumn("more", (F.col("sofar") + F.col("n_tokens") / 2 <= F.col("part")).cast("int"))
    repeats = (F.col("whole") + F.col("more")).alias("repeats")
    columns = [key, "source", "n_tokens", repeats]
    return clear.select(*columns).unionByName(edge.select(*columns)).filter("repeats > 0")


def _cuts(docs: DataFrame, bucket: str, cut: str) -> DataFrame:
    """``source, cut, before``: the bucket in which each source's part ends, and its tokens in front of that bucket.

    ``docs`` has ``part`` and ``before``, the tokens in front of all of its buckets.
    """
    sums = docs.groupBy("source", bucket).agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"), F.first("before").alias("start"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    reached = sums.withColumn("before", F.col("start") + F.coalesce(upto, F.lit(0))).filter("before < part and before + n >= part")
    return reached.groupBy("source").agg(F.min(bucket).alias(cut), F.min("before").alias("before"))


def reached_shares(mix: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: ``target_share, max_repeats, available_tokens, used_docs, used_tokens, epochs, share, clamped``.

    A source is clamped if every document of it is used ``max_repeats`` times.
    """
    targets = targets.select("source", "target_share", "max_repeats")
    tokens = F.col("n_tokens") * F.col("repeats")
    used = mix.groupBy("source").agg(F.count("*").alias("used_docs"), F.sum(tokens).alias("used_tokens"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    joined = targets.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["available_tokens", "used_docs", "used_tokens"])
    whole = Window.partitionBy(F.lit(1))  # one row per target
    return joined.select(
        "source", "target_share", "max_repeats", "available_tokens", "used_docs", "used_tokens",
        F.try_divide("used_tokens", "available_tokens").alias("epochs"),
        F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(whole)).alias("share"),
        ((F.col("used_tokens") > 0) & (F.col("used_tokens") == F.col("available_tokens") * F.coalesce("max_repeats", F.lit(1)))).alias("clamped"),
    )
