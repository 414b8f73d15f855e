"""Problem 8: documents combined so that each source contributes its share of all tokens.

Method: entropy balancing.  Each document gets a rate w (its expected copies) as close
as possible, in Kullback-Leibler divergence, to one copy of everything, under the
condition that the rates of a source bring exactly its tokens: w = exp(lambda *
tokens / scale), cut off at the source's max_repeats.  The dual is convex; its Newton
steps (kept inside a bracket) need only sums over documents, and since documents
of equal source and length have equal rates, these are summed over lengths once.
Rates become whole copies by systematic rounding in order of length, which
keeps each source within about one document of its tokens.

The total is, unless given, the largest one at which every source that has tokens
reaches its share.  A source without documents or tokens can't contribute: the other
sources keep their proportions to each other, and the report says so.

Defined cases: null or empty texts have no tokens and get no copies, as do documents
whose source is null or has no target; rows without identifier are left out; targets
with a null source, a share that is null or not positive, or max_repeats below one
are ignored; shares of a source stated twice add up, with the smaller max_repeats.
"""

from __future__ import annotations

import base64
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.runtime import materialize

#: Rank file of a public byte-level tokenizer, and the pattern that splits text before its merges (fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Newton steps at most, relative error at which a source is balanced, and parts that a group of equal documents is cut into.
STEPS = 60
TOLERANCE = 1e-10
SALTS = 64
#: Offsets of the systematic rounding that are tried.
OFFSETS = 16


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of all rows of (doc_id, source, text)."""

    def per_task(batches):
        encode = _encoder(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.mapInArrow(per_task, "doc_id bigint, source string, tokens bigint")


def valid_targets(targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats), one row per source."""
    rows = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source IS NOT NULL AND share > 0 AND share < double('infinity') AND max_repeats >= 1")
    return rows.groupBy("source").agg(F.sum("share").alias("share"), F.min("max_repeats").alias("max_repeats"))


def _balance(lengths: DataFrame, plan: dict[str, tuple[float, int]], scale: float) -> dict[str, float]:
    """lambda of each source: distributed Newton steps on the dual, for all sources at once.

    lengths: (source, tokens, docs).  plan: target tokens and max_repeats per source.
    An infinite lambda means that every document is used max_repeats times.
    """
    spark = lengths.sparkSession
    out = {s: math.inf if target >= r * full * (1 - 1e-12) else 0.0 for s, (target, r, full) in plan.items()}
    low, high = {s: -math.inf for s in plan}, {s: math.inf for s in plan}
    open_ = {s for s in plan if math.isfinite(out[s])}
    for _ in range(STEPS):
        if not open_:
            break
        now = spark.createDataFrame([(s, out[s], float(plan[s][1])) for s in sorted(open_)], "source string, lam double, r double")
        x = F.col("tokens") / F.lit(scale)
        power = F.col("lam") * x
        # exp only where it can't overflow; beyond the cut-off the rate is constant.
        rate = F.when(power >= F.log("r"), F.col("r")).otherwise(F.exp(F.least(power, F.log("r"))))
        slope = F.when(power >= F.log("r"), F.lit(0.0)).otherwise(rate * x)
        t = F.col("tokens") * F.col("docs")
        sums = lengths.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(rate * t).alias("g"), F.sum(slope * t).alias("h")).collect()
        for s, g, h in sums:
            target = plan[s][0]
            error = g - target
            if abs(error) <= TOLERANCE * max(1.0, target):
                open_.discard(s)
                continue
            if error > 0:
                high[s] = out[s]
            else:
                low[s] = out[s]
            step = out[s] - error / h if h > 0 else math.nan
            if not (low[s] < step < high[s]):
                if math.isinf(low[s]):
                    step = min(2 * out[s], out[s] - 1.0)
                elif math.isinf(high[s]):
                    step = max(2 * out[s], out[s] + 1.0)
                else:
                    step = (low[s] + high[s]) / 2
            if step == out[s]:
                open_.discard(s)
            out[s] = step
    return out


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Copies (doc_id, source, tokens, rate, copies) of every document of a source with a target, and the report.

    The report has one row per target source: (source, target_share, max_repeats,
    documents, tokens, target_tokens, used_documents, copies, used_tokens, actual_share).
    """
    spark = documents.sparkSession
    goals = valid_targets(targets)
    # The targets are a stated table with a row per source; its size is checked before it is gathered.
    if goals.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 sources with targets")
    stated = goals.collect()
    whole = math.fsum(r["share"] for r in stated) or 1.0
    wanted = {r["source"]: (r["share"] / whole, r["max_repeats"]) for r in stated}
    names = spark.createDataFrame([(s,) for s in sorted(wanted)], "source string")
    rows = documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL AND source IS NOT NULL").join(F.broadcast(names), "source", "left_semi")
    counted = materialize(token_counts(rows, tokenizer), "p8-tokens")
    lengths = materialize(counted.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("docs")), "p8-lengths")
    have = {r["source"]: (r["t"], r["n"]) for r in lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("t"), F.sum("docs").alias("n")).collect()}
    present = {s: share for s, (share, _) in wanted.items() if s in have}
    whole = sum(present.values())
    share = {s: x / whole for s, x in present.items()}
    most = min((wanted[s][1] * have[s][0] / share[s] for s in share), default=0.0)
    total = most if total_tokens is None else float(total_tokens)
    plan = {s: (min(share[s] * total, wanted[s][1] * have[s][0]), wanted[s][1], have[s][0]) for s in share}
    scale = max(1.0, sum(t for t, _ in have.values()) / max(1, sum(n for _, n in have.values())))
    lam = _balance(lengths, plan, scale)
    tilt = spark.createDataFrame([(s, lam[s], float(plan[s][1])) for s in sorted(plan)], "source string, lam double, r double")
    power = F.col("lam") * F.col("tokens") / F.lit(scale)
    rate = F.when(power >= F.log("r"), F.col("r")).otherwise(F.exp(F.least(power, F.log("r"))))
    rated = lengths.join(F.broadcast(tilt), "source").select("source", "tokens", "docs", rate.alias("rate"), "r")
    # Running sums over the lengths of a source (one row per length, not per document).
    upto = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    offset = rated.withColumn("before", F.coalesce(F.sum(F.col("rate") * F.col("docs")).over(upto), F.lit(0.0))).select("source", "tokens", "rate", "r", "before")
    # Rank among documents of equal source and length, in parts so that no group is gathered whole.
    salted = counted.where("tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    sizes = salted.groupBy("source", "tokens", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("source", "tokens", "salt", "skip")
    within = F.row_number().over(Window.partitionBy("source", "tokens", "salt").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))
    placed = salted.withColumn("rank", within).join(base, ["source", "tokens", "salt"]).join(offset, ["source", "tokens"])
    at = F.col("skip") + F.col("rank")
    begin, end = F.col("before") + (at - 1) * F.col("rate"), F.col("before") + at * F.col("rate")
    placed = placed.select("doc_id", "source", "tokens", "rate", "r", begin.alias("begin"), end.alias("end"))

    def rounded(u) -> F.Column:
        return F.least(F.floor(F.col("end") + u) - F.floor(F.col("begin") + u), F.col("r").cast("long"))

    # Systematic rounding is right at any offset; per source the one of OFFSETS that comes nearest to its tokens is taken.
    marks = [(k + 0.5) / OFFSETS for k in range(OFFSETS)]
    tried = placed.groupBy("source").agg(*[F.sum(rounded(F.lit(u)) * F.col("tokens")).alias(f"u{k}") for k, u in enumerate(marks)]).collect()
    nearest = [(r["source"], marks[min(range(OFFSETS), key=lambda k: (abs(r[f"u{k}"] - plan[r["source"]][0]), k))]) for r in tried]
    offsets = spark.createDataFrame(nearest, "source string, u double")
    chosen = placed.join(F.broadcast(offsets), "source").select("doc_id", "source", "tokens", "rate", rounded(F.col("u")).alias("copies"))
    none = counted.where("tokens = 0").select("doc_id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    chosen = materialize(chosen.unionByName(none), "p8-copies")
    goal = spark.createDataFrame([(s, wanted[s][0], wanted[s][1], float(plan[s][0]) if s in plan else 0.0) for s in sorted(wanted)], "source string, target_share double, max_repeats int, target_tokens double")
    used = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.count_if(F.col("copies") > 0).alias("used_documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"))
    zero = {c: 0 for c in ("documents", "tokens", "used_documents", "copies", "used_tokens")}
    report = goal.join(used, "source", "left").fillna(zero)
    used_all = int(chosen.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 0)
    report = report.withColumn("actual_share", F.col("used_tokens") / F.lit(float(max(1, used_all))))
    return chosen, report.select("source", "target_share", "max_repeats", "documents", "tokens", "target_tokens", "used_documents", "copies", "used_tokens", "actual_share")


def mixing_report(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    return mix(documents, targets, **options)[1]


def mixing_copies(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    return mix(documents, targets, **options)[0]
