"""Predict-and-score and detailed evaluation as lazy plans.

* ``score_predictions``: samples -> predictor (J1) -> pairing (D10) ->
  exact match overall (E1) and by language x sem_type (E6).
* ``evaluate_hypotheses``: n-best hypotheses -> length normalisation (F5)
  -> ranking (F6) -> n-best (F4) -> decode (C7) -> codes (A6) -> full and
  partial accuracy per code and overall (E3, E5), top-1 accuracy (E7) and the
  report lines (E11).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmetric.functions.columns import length_normalized, partial_accuracy, exact
from lexmetric.operators import metrics as E
from lexmetric.operators.predict import predict
from lexmetric.operators.ranking import rank_hypotheses
from lexmetric.operators.shape import pair_predictions
from lexmetric.operators.tokens import decode
from lexmetric.sources.codes import attach_codes


def score_predictions(samples: DataFrame, make_fn: Callable, batch_size: int = 64,
                      key: str = "sample_id") -> dict[str, DataFrame]:
    preds = predict(samples, make_fn, batch_size=batch_size, keep=("label",), key=key)
    paired = pair_predictions(samples.drop("label"), preds.drop("text"), key)
    scored = paired.withColumn("correct", exact("generated", "label"))
    return {
        "predictions": paired,
        "exact_match": E.exact_match(paired),
        "breakdown": E.accuracy_breakdown(scored),
    }


def evaluate_hypotheses(hyps: DataFrame, targets: DataFrame, vocab: DataFrame,
                        codes: DataFrame | None, n: int = 1, penalty: float = 1.0,
                        key: str = "sample_id", model: str | None = None) -> dict[str, DataFrame]:
    """``hyps``: (sample_id, beam, tokens ARRAY<INT>, score); ``targets``:
    (sample_id, pos, target_tokens ARRAY<INT>).  A sample without a target
    stays, as a wrong answer without partial accuracy.  With ``model`` (its name) the
    report is the whole one (``full_report``)."""
    normed = hyps.withColumn("score", length_normalized("score", F.size("tokens") + 1, penalty))
    best = rank_hypotheses(normed, "score", key, tie=("beam",), top=n)
    decoded = decode(best.withColumn("_hid", F.struct(key, "beam")),
                     vocab, "tokens", "hyp_text", key="_hid").drop("_hid")
    tgt = decode(targets, vocab, "target_tokens", "ref_text", key=key)
    joined = decoded.join(tgt, key, "left")
    # Scored before the join with the codes, which then moves no text or token for the summary.
    judged = joined.withColumn("correct", exact("hyp_text", "ref_text")).withColumn(
        "partial", partial_accuracy("tokens", "target_tokens"))
    scored = attach_codes(judged, codes)
    scored = scored.select(*[c for c in scored.columns if c not in ("correct", "partial")], "correct", "partial")
    summary = E.summary_table(scored)
    return {
        "scored": scored,
        "summary": summary,
        "top1": E.top1_accuracy(scored),
        "report": E.full_report(summary, model) if model else E.report_lines(summary),
    }
