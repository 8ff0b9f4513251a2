"""Windows, ranking, sorts and top-k.

Running values over potentially large groups (a training epoch, a code's
batches) use the chunked scan from ``sequence``; per-sample windows over
hypotheses or candidates are bounded by the beam and vocabulary step, and
``row_number() <= k`` is planned as a ``WindowGroupLimit`` (map-side top-k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.functions.columns import length_normalized
from lexmetric.operators.sequence import group_top_k, running

NEG_INF = float("-inf")


def running_loss(log: DataFrame, strategy: str = "chunked") -> DataFrame:
    """running mean of the loss within an epoch (per run and split), with
    the running sum and count it is made of."""
    out = running(log, ["run", "split", "epoch"], ["step"],
                  {"running_sum": ("sum", "loss"), "running_count": ("count", "loss")},
                  strategy=strategy)
    return out.withColumn("running_loss", F.col("running_sum") / F.col("running_count"))


def running_accuracy(df: DataFrame, code: str = "code", batch: str = "batch_id",
                     correct: str = "correct", partial: str = "partial",
                     strategy: str = "chunked") -> DataFrame:
    """full and partial accuracy so far after each batch, per code and
    overall (``key = 'average'``).  Aggregate per (code, batch) first, then a
    running sum over batches -- linear, where the reference re-averages its
    lists after every batch."""
    per = df.groupingSets([[code, batch], [batch]], code, batch).agg(
        F.sum(correct).cast("long").alias("_c"), F.sum(partial).alias("_p"),
        F.count(F.lit(1)).alias("_n"), F.grouping(code).alias("_g"))
    per = per.withColumn("key", F.when(F.col("_g") == 1, F.lit("average"))
                         .otherwise(F.col(code).cast("string")))
    run = running(per, ["_g", "key"], [batch],
                  {"_sc": ("sum", "_c"), "_sp": ("sum", "_p"), "_sn": ("sum", "_n")},
                  strategy=strategy)
    return run.select(
        "key", (F.col("_g") == 1).alias("is_overall"), batch,
        F.col("_sn").alias("n_so_far"),
        (F.col("_sc") / F.col("_sn")).alias("full_so_far"),
        (F.col("_sp") / F.col("_sn")).alias("partial_so_far"))


def best_checkpoints(epoch_losses: DataFrame, loss: str = "mean_loss") -> DataFrame:
    """epochs whose loss strictly beats every earlier epoch of the same
    (run, split).  The table has one row per epoch, so the window is bounded."""
    w = Window.partitionBy("run", "split").orderBy("epoch").rowsBetween(
        Window.unboundedPreceding, -1)
    prev = F.min(loss).over(w)
    return (epoch_losses.withColumn("best_before", prev)
            .withColumn("improved", prev.isNull() | (F.col(loss) < prev)))


def final_best(epoch_losses: DataFrame, loss: str = "mean_loss") -> DataFrame:
    """the best epoch per (run, split); a tie keeps the earliest epoch."""
    return epoch_losses.groupBy("run", "split").agg(
        F.min_by("epoch", F.struct(F.col(loss), F.col("epoch"))).alias("best_epoch"),
        F.min(loss).alias("best_loss"))


def n_best(hyps: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    """the first ``n`` ranked hypotheses per sample."""
    return hyps.filter(F.col(rank) <= n)


def rank_hypotheses(hyps: DataFrame, score: str = "score", key: str = "sample_id",
                    tie: tuple[str, ...] = ("beam",), top: int | None = None,
                    rank: str = "rank", strategy: str = "chunked") -> DataFrame:
    """rank per sample by score descending, ties by ``tie`` ascending.

    With ``top`` only the best ``top`` rows are kept and ranked
    (``WindowGroupLimit``: each task pre-filters its own top rows).  The full
    ranking is a running count, chunked when a sample is too large for one
    task.
    """
    order = [F.desc(score)] + [F.asc(t) for t in tie]
    if top is not None:
        return group_top_k(hyps, key, order, top, rank)
    ranked = running(hyps, [key], order, {rank: ("count", F.lit(1))}, strategy=strategy)
    return ranked.withColumn(rank, F.col(rank).cast("int"))


def top_candidates(cands: DataFrame, beam: int, group: list[str], eos: int,
                   score: str = "lprob", token: str = "token_id",
                   tie: tuple[str, ...] = ()) -> DataFrame:
    """per group the ``2 * beam`` best candidates, each tagged

    * ``finished``: eos within the first ``beam`` with a score above ``-inf``;
    * ``active``: among the first ``beam`` candidates that end nothing, an eos
      of score ``-inf`` included (it may fill a slot like any other token);
    * neither: kept for the record with both flags false.
    """
    order = [F.desc(score), F.asc(token)] + [F.asc(t) for t in tie]
    top = group_top_k(cands, group, order, 2 * beam, "cand_rank")
    is_eos = F.coalesce((F.col(token) == F.lit(eos)) & (F.col(score) != F.lit(NEG_INF)), F.lit(False))
    finished = is_eos & (F.col("cand_rank") <= beam)
    nonfinal = top.withColumn("_eos", is_eos)
    w = Window.partitionBy(*group, "_eos").orderBy("cand_rank")
    return (nonfinal.withColumn("_r2", F.row_number().over(w))
            .withColumn("finished", finished)
            .withColumn("active", ~F.col("_eos") & (F.col("_r2") <= beam))
            .drop("_eos", "_r2"))


def finished_quota(hyps: DataFrame, beam: int, max_len: int, key: str = "sample_id",
                   step: str = "step", rank: str = "rank") -> DataFrame:
    """F8: keep the first ``beam`` finished hypotheses per sample in (step,
    rank) order; ``done_step`` is the step of the ``beam``-th one, else
    ``max_len``."""
    kept = group_top_k(hyps, key, [F.asc(step), F.asc(rank)], beam, "finish_order")
    # At most ``beam`` rows a sample are left, so a window over them is bounded.
    done = F.max(F.when(F.col("finish_order") == beam, F.col(step))).over(Window.partitionBy(key))
    return kept.withColumn("done_step", F.coalesce(done, F.lit(max_len)).cast("long"))


def position_scores(df: DataFrame, key: str, order: list[str], cumulative: str = "cum_score",
                    out: str = "pos_score", strategy: str = "chunked") -> DataFrame:
    """F9 (long form): cumulative -> per-position scores, ``s - lag(s, 1, 0)``.

    The lag is a running scan, chunked when a sample is too large for one
    task (the previous row of a chunk's first row comes from the last row of
    the chunk before it)."""
    lagged = running(df, [key], order, {"_prev": ("lag", cumulative)}, strategy=strategy)
    return lagged.withColumn(out, F.col(cumulative) - F.coalesce(F.col("_prev"), F.lit(0.0))) \
        .drop("_prev")


def position_scores_array(c) -> "F.Column":
    """F9 (array form): ``zip_with(s, [0] + s, (a, b) -> a - b)``."""
    s = F.col(c) if isinstance(c, str) else c
    return F.filter(
        F.zip_with(s, F.concat(F.array(F.lit(0.0)), s), lambda a, b: a - b),
        lambda x, i: i < F.size(s))


def log_softmax(cands: DataFrame, group: list[str], temperature: float = 1.0,
                logit: str = "lprob", out: str = "log_prob") -> DataFrame:
    """``x/T - m - ln(sum(exp(x/T - m)))`` within each group."""
    if not temperature > 0:
        raise ValueError("temperature must be greater than 0")
    # A group is one score table, bounded by the vocabulary: one shuffle, null keys kept.
    w = Window.partitionBy(*group)
    scaled = cands.withColumn("_x", F.col(logit) / F.lit(float(temperature)))
    scaled = scaled.withColumn("_m", F.max("_x").over(w))
    return (scaled.withColumn("_lse", F.log(F.sum(F.exp(F.col("_x") - F.col("_m"))).over(w)))
            .withColumn(out, F.col("_x") - F.col("_m") - F.col("_lse"))
            .drop("_x", "_m", "_lse"))


def constrain_scores(cands: DataFrame, pad: int, unk: int, eos: int,
                     unk_penalty: float = 0.0, min_len: int = 1, max_len: int | None = None,
                     token: str = "token_id", step: str = "step",
                     score: str = "lprob", prefix: str | None = None) -> DataFrame:
    """NaN -> -inf; pad -> -inf; unk minus a penalty; at ``max_len``
    only eos survives; below ``min_len`` eos is banned.

    ``prefix`` names a column with the token forced at this step (null or pad:
    none).  Where one is forced only that token keeps its score (F12) and the
    minimum length does not apply."""
    s, t = F.col(score), F.col(token)
    inf = F.lit(NEG_INF)
    v = F.when(F.isnan(s), inf).otherwise(s)
    v = F.when(t == F.lit(pad), inf).otherwise(v)
    v = F.when(t == F.lit(unk), v - F.lit(float(unk_penalty))).otherwise(v)
    if max_len is not None:
        v = F.when((F.col(step) >= F.lit(max_len)) & (t != F.lit(eos)), inf).otherwise(v)
    short = (F.col(step) < F.lit(min_len)) & (t == F.lit(eos))
    if prefix is None:
        v = F.when(short, inf).otherwise(v)
    else:
        forced = F.coalesce(F.col(prefix) != F.lit(pad), F.lit(False))
        v = F.when(F.when(forced, t != F.col(prefix)).otherwise(short), inf).otherwise(v)
    return cands.withColumn(score, v)


def force_prefix(cands: DataFrame, prefix: DataFrame, key: list[str], pad: int,
                 token: str = "token_id", score: str = "lprob") -> DataFrame:
    """where a prefix token is given (not pad), only that token keeps
    its score.  ``prefix`` has ``key + ['prefix_token']``."""
    p = prefix.filter(F.col("prefix_token") != F.lit(pad))
    return (cands.join(p, key, "left")
            .withColumn(score, F.when(F.col("prefix_token").isNotNull()
                                      & (F.col(token) != F.col("prefix_token")),
                                      F.lit(NEG_INF)).otherwise(F.col(score)))
            .drop("prefix_token"))


def reject_overlong(hyps: DataFrame, match_source_len: bool = True, step: str = "step",
                    src_len: str = "src_len", score: str = "score") -> DataFrame:
    """score -> -inf when the step exceeds the source length."""
    if not match_source_len:
        return hyps
    return hyps.withColumn(score, F.when(F.col(step) > F.col(src_len), F.lit(NEG_INF))
                           .otherwise(F.col(score)))


__all__ = [
    "best_checkpoints", "constrain_scores", "final_best", "finished_quota", "force_prefix",
    "length_normalized", "log_softmax", "n_best", "position_scores", "position_scores_array",
    "rank_hypotheses", "reject_overlong", "running_accuracy", "running_loss", "top_candidates",
]
