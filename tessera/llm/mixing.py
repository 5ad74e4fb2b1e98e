"""Problem 7: mixing sources to target weights.

Entropy balancing: of all ways to use the documents, the one nearest (in relative entropy of
token mass) to using each once, under the constraints that

- each source reaches its share of the tokens,
- the token-weighted mean of the documents' log length stays that of the pool, so that giving
  sources other weights does not make the mix one of longer or shorter documents (a soft
  constraint, PULL, as caps and shares may not allow it fully),
- no document exceeds its cap.

Its solution is an exponential tilt of the documents' rates, rate = min(cap, exp(lambda of the
source + mu * length of the document)). The multipliers are found by Newton iterations on the
convex dual, in which mu couples all sources: gradient and Hessian (an arrow matrix, one row per
source and one for mu) are one aggregate over the histogram of (source, tokens) in each
iteration, and a step is taken only as far as the dual falls.

The mix is as large as the caps allow. A source that is scarcest against its weight is used up to
its cap throughout; the others less, by their rates. Rates are rounded into copies by diffusing
the error in tokens along the histogram, longest documents first, so that the short ones even out
what the long ones miss.

Sources are compared trimmed and in lower case. Documents of a null, blank or untargeted source
and those without a token take no part. A target without documents cannot be reached: its
weight goes to the other targets in proportion, and the report shows it with share 0. A null or
negative weight or cap counts as 0. Repeated target rows count once, with the greatest weight
and cap. Empty tables give an empty mix. Other columns are not read. The targets, one row per
source, are held by the driver: more than MOST_TARGETS of them are refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.encoding import token_count
from tessera.llm.ranks import ranked
from tessera.session import cut

ITERATIONS, TOLERANCE = 40, 1e-9
#: The cost of mu, as a share of the mix's tokens: mu is at most the mix's remaining deviation in mean log
#: length, in standard deviations of the pool, divided by this.
PULL = 1.0
MOST_TARGETS = 100_000


def _name(column: str):
    return F.lower(F.btrim(F.col(column)))


def _targets(targets: DataFrame) -> DataFrame:
    clean = targets.select(_name("source").alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
    return clean.where("source is not null and source <> ''").groupBy("source").agg(F.max("weight").alias("weight"), F.max("cap").alias("cap"))


def _wanted(targets: DataFrame) -> dict[str, tuple[float, float]]:
    """Weight and cap of each source that can take part."""
    rows = _targets(targets).where("weight > 0 and cap > 0").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return {r.source: (float(r.weight), float(r.cap)) for r in rows}


def sized(documents: DataFrame, wanted: dict[str, tuple[float, float]], path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents that may take part, kept as three narrow columns."""
    spark = documents.sparkSession
    small = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))  # at most MOST_TARGETS rows
    named = documents.select("doc_id", _name("source").alias("source"), "text").join(small, "source", "left_semi")
    return cut(named.select("doc_id", "source", token_count(F.col("text"), documents, path).alias("tokens")).where("tokens > 0"))


def multipliers(histogram: DataFrame, wanted: dict[str, tuple[float, float]]) -> tuple[dict[str, float], float, float, float]:
    """The dual's solution: lambda per source (infinite where the cap binds throughout), mu, and the
    mean and deviation of log length in the pool."""
    spark = histogram.sparkSession
    mass, log = F.col("tokens") * F.col("n"), F.log("tokens")
    totals = histogram.groupBy("source").agg(F.sum(mass).cast("double").alias("mass"), F.sum(mass * log).alias("first"), F.sum(mass * log * log).alias("second")).collect()
    if not totals:
        return {}, 0.0, 0.0, 1.0
    sources = sorted(r.source for r in totals)
    at = {s: i for i, s in enumerate(sources)}
    pool, first, second = (np.zeros(len(sources)) for _ in range(3))
    for r in totals:
        pool[at[r.source]], first[at[r.source]], second[at[r.source]] = r.mass, r.first, r.second
    mean = first.sum() / pool.sum()
    deviation = max(1e-6, float(np.sqrt(max(0.0, second.sum() / pool.sum() - mean * mean))))
    weight, cap = (np.array([wanted[s][k] for s in sources]) for k in (0, 1))
    share = weight / weight.sum()
    size = (cap * pool / share).min()
    goal = size * share
    full = goal >= cap * pool * (1 - 1e-9)  # used up to the cap throughout
    tilt, mu, pull = np.where(full, np.inf, np.log(goal / pool)), 0.0, PULL * size
    x = (log - mean) / deviation

    def state(tilt: np.ndarray, mu: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual, and per source: tokens and token-weighted length reached, and the three second derivatives."""
        rows = spark.createDataFrame([(s, float(min(t, 700.0)), float(c)) for s, t, c in zip(sources, tilt, cap)], "source string, tilt double, cap double")
        power = F.col("tilt") + F.lit(float(mu)) * x
        rate, free = F.least(F.exp(power), F.col("cap")), power < F.log("cap")
        inner = F.when(free, F.exp(power)).otherwise(F.col("cap") * (1 + power - F.log("cap")))  # its derivative is the rate
        slope = F.when(free, mass * rate).otherwise(0.0)
        sums = histogram.join(F.broadcast(rows), "source").groupBy("source").agg(F.sum(mass * inner), F.sum(mass * rate), F.sum(mass * rate * x), F.sum(slope), F.sum(slope * x), F.sum(slope * x * x)).collect()
        out = np.zeros((len(sources), 6))
        for r in sums:
            out[at[r.source]] = [float(v) for v in r[1:]]
        out[full, 0], out[full, 3:] = 0.0, 0.0
        out[full, 2] = cap[full] * (first[full] - mean * pool[full]) / deviation
        dual = out[:, 0].sum() - (np.where(full, 0.0, tilt) * goal).sum() + mu * out[full, 2].sum() + pull * mu * mu / 2
        return dual, out[:, 1:3], out[:, 3:]

    dual, reached, slopes = state(tilt, mu)
    for _ in range(ITERATIONS):
        miss = np.where(full, 0.0, reached[:, 0] - goal)
        lean = reached[:, 1].sum() + pull * mu
        if (np.abs(miss) < TOLERANCE * goal).all() and abs(lean) < 1e-6 * size:
            break
        free = ~full & (slopes[:, 0] > 0)
        a, b = slopes[free, 0], slopes[free, 1]
        corner = slopes[:, 2].sum() + pull - (b * b / a).sum()
        down = -(lean - (b / a * miss[free]).sum()) / corner
        step = np.zeros(len(sources))
        step[free] = (-miss[free] - b * down) / a
        length = 1.0
        while True:
            after = state(tilt + length * step, mu + length * down)
            if after[0] <= dual + 1e-12 * abs(dual) or length < 1e-4:
                break
            length /= 2
        tilt, mu = tilt + length * step, mu + length * down
        dual, reached, slopes = after
    return dict(zip(sources, tilt)), float(mu), float(mean), deviation


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of each length of one source: all get `base`, the first `extra` one more."""
    rows = rows.sort_values("tokens", ascending=False)
    base, extra, carry = [], [], 0.0
    for tokens, n, rate, cap in zip(rows["tokens"], rows["n"], rows["rate"], rows["cap"]):
        floor = int(min(rate + 1e-12, cap))
        carry += n * (rate - floor) * tokens
        k = min(max(round(carry / tokens), 0), int(n)) if floor < cap else 0
        carry -= k * tokens
        base.append(floor)
        extra.append(k)
    return rows[["source", "tokens"]].assign(base=base, extra=extra)


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used."""
    spark = documents.sparkSession
    wanted = _wanted(targets)
    docs = sized(documents, wanted, path)
    histogram = cut(docs.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    tilt, mu, mean, deviation = multipliers(histogram, wanted)
    rows = spark.createDataFrame([(s, float(min(v, 700.0)), int(wanted[s][1])) for s, v in tilt.items()], "source string, tilt double, cap int")
    rate = F.least(F.exp(F.col("tilt") + F.lit(mu) * (F.log("tokens") - F.lit(mean)) / F.lit(deviation)), F.col("cap").cast("double"))
    copies = histogram.join(F.broadcast(rows), "source").withColumn("rate", rate).groupBy("source").applyInPandas(_round, "source string, tokens int, base int, extra int")
    keyed = docs.withColumn("size", F.concat_ws("\x00", "source", "tokens"))
    # ranks decide which of equally long documents get one copy more
    placed = ranked(keyed, "size", "doc_id").select("doc_id", "source", "tokens", "rank").join(copies, ["source", "tokens"])
    return placed.select("doc_id", "source", "tokens", (F.col("base") + (F.col("rank") < F.col("extra")).cast("int")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, tokens, share, documents, copies) of each target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    whole = F.sum("tokens").over(_all())
    filled = _targets(targets).join(got, "source", "left").select("source", "weight", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "documents", "copies")))
    return filled.withColumn("share", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)).otherwise(0.0))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over one row per target
