"""Aggregations.

Every metric is a grouped aggregate with map-side partial aggregation, so a
hot code or a hot sample is reduced inside each task before the shuffle.  The
overall row of a per-code table is a grouping set, labelled with
``grouping()`` -- never by a null code, since a missing code is its own group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.functions.columns import exact, format_exact, format_repr, partial_accuracy
from lexmetric.operators.sequence import running

OVERALL = "average"
#: Outcomes a row of packed lists holds.
CHUNK_BITS = 2 ** 16


def with_outcomes(df: DataFrame, hyp: str = "generated", ref: str = "label",
                  hyp_tokens: str | None = "hyp_tokens",
                  ref_tokens: str | None = "ref_tokens") -> DataFrame:
    """Per-row ``correct`` (0/1 exact match) and ``partial``."""
    out = df.withColumn("correct", exact(hyp, ref))
    if hyp_tokens and ref_tokens:
        out = out.withColumn("partial", partial_accuracy(hyp_tokens, ref_tokens))
    return out


def exact_match(df: DataFrame, hyp: str = "generated", ref: str = "label") -> DataFrame:
    """Share of rows whose prediction equals the reference."""
    return df.agg(F.avg(exact(hyp, ref).cast("double")).alias("exact_match"),
                  F.count(F.lit(1)).alias("n"))


def accuracy_by_code(df: DataFrame, code: str = "code", correct: str = "correct",
                     pos: str | None = None) -> DataFrame:
    """Correct and total per code, and their ratio; with ``pos`` also
    ``first_pos``, the first position where the code appears."""
    first = [F.min(pos).alias("first_pos")] if pos else []
    return (df.groupBy(code)
            .agg(F.sum(correct).cast("long").alias("n_correct"), F.count(F.lit(1)).alias("n"), *first)
            .withColumn("accuracy", F.col("n_correct") / F.col("n")))


def _by_code_and_overall(df: DataFrame, value: str, out: str, code: str) -> DataFrame:
    g = df.groupingSets([[code], []], code).agg(
        F.avg(F.col(value).cast("double")).alias(out),
        F.count(F.lit(1)).alias("n"),
        F.grouping(code).alias("_g"))
    return (g.withColumn("key", F.when(F.col("_g") == 1, F.lit(OVERALL))
                         .otherwise(F.col(code).cast("string")))
            .withColumn("is_overall", F.col("_g") == 1).drop("_g"))


def full_accuracy(df: DataFrame, code: str = "code", correct: str = "correct") -> DataFrame:
    """Mean exact match per code and overall (``key = 'average'``)."""
    return _by_code_and_overall(df, correct, "full", code)


def partial_accuracy_table(df: DataFrame, code: str = "code", partial: str = "partial") -> DataFrame:
    """E5: mean partial accuracy (E4) per code and overall."""
    return _by_code_and_overall(df, partial, "partial", code)


def accuracy_breakdown(df: DataFrame, correct: str = "correct",
                       dims: tuple[str, ...] = ("language", "sem_type")) -> DataFrame:
    """Exact match by language x sem_type with all subtotals (a cube)."""
    return (df.cube(*dims).agg(
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
        F.grouping_id(*dims).alias("level")))


def top1_accuracy(df: DataFrame, rank: str = "rank", correct: str = "correct") -> DataFrame:
    """Correct / wrong / total over the best hypothesis of every sample."""
    best = df.filter(F.col(rank) == 1)
    return best.agg(
        F.sum(correct).cast("long").alias("n_correct"),
        F.sum(1 - F.col(correct)).cast("long").alias("n_wrong"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("accuracy", F.col("n_correct") / F.col("n"))


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Rows per filter outcome, most common first."""
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), outcome)


def outcomes_per_code(df: DataFrame, code: str = "code", pos: str = "pos",
                      correct: str = "correct") -> DataFrame:
    """The 0/1 outcome list per code, kept long: ``(code, pos, ok)``.

    The reference builds one Python list per code; a list per code grows with
    the data, so here the list is a table keyed by (code, pos).  Right and
    wrong examples are ``right_examples`` / ``wrong_examples``; the list itself,
    packed, is ``outcome_bits``.
    """
    return df.select(code, pos, (F.col(correct) == 1).alias("ok"))


def outcome_bits(df: DataFrame, code: str = "code", pos: str = "pos", correct: str = "correct",
                 chunk: int = CHUNK_BITS) -> DataFrame:
    """The 0/1 list of every code, packed: ``(code, chunk, n, n_right, bits)``.

    Bit ``i % 64`` of word ``i // 64`` is the i-th outcome of the code along
    ``pos`` (unique within a code); a row holds at most ``chunk`` outcomes (a
    multiple of 64), so no row grows with the data.  Places come from the
    chunked running count, so a hot code is spread over tasks.  A null outcome
    is wrong, a null code a list of its own, an empty table gives no rows.
    """
    if chunk < 64 or chunk % 64:
        raise ValueError("chunk must be a multiple of 64")
    ok = F.coalesce(F.col(correct) == 1, F.lit(False))
    placed = running(df.select(F.col(code).alias("_code"), F.col(pos).alias("_pos"), ok.alias("_ok")),
                     ["_code"], ["_pos"], {"_i": ("count", F.lit(1))}, exclusive=True)
    bit = F.when(F.col("_ok"), F.expr("shiftleft(1L, CAST(_i % 64 AS INT))")).otherwise(F.lit(0).cast("long"))
    by_word = placed.groupBy("_code", F.floor(F.col("_i") / 64).alias("_word")).agg(
        F.bit_or(bit).alias("_bits"), F.count(F.lit(1)).alias("_n"))
    packed = by_word.groupBy("_code", F.floor(F.col("_word") / (chunk // 64)).cast("long").alias("chunk")).agg(
        F.sum("_n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"]).alias("bits"))
    right = F.aggregate("bits", F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))
    return packed.select(F.col("_code").alias(code), "chunk", "n", right.alias("n_right"), "bits")


def outcomes_of_bits(bits: DataFrame) -> DataFrame:
    """The packed lists unpacked within their rows: ``outcomes``, an array
    of 0/1 per (code, chunk)."""
    def bit(i):
        return F.expr("CAST(1 AS BIGINT)").bitwiseAND(F.call_function(
            "shiftrightunsigned", F.get("bits", F.floor(i / 64).cast("int")), (i % 64).cast("int"))).cast("int")
    return bits.withColumn("outcomes", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), bit)).drop("bits")


def accuracy_of_bits(bits: DataFrame, code: str = "code") -> DataFrame:
    """E2 from the packed lists: a count of bits per chunk, a sum per code."""
    return bits.groupBy(code).agg(F.sum("n").alias("n"), F.sum("n_right").alias("n_correct")) \
        .withColumn("accuracy", F.col("n_correct") / F.col("n"))


def right_examples(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("ok")


def wrong_examples(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(~F.col("ok"))


def token_totals(df: DataFrame, tokens: str = "hyp_tokens", rank: str | None = None) -> DataFrame:
    """Generated tokens of the best hypothesis, summed."""
    best = df.filter(F.col(rank) == 1) if rank else df
    return best.agg(F.sum(F.size(tokens)).cast("long").alias("n_tokens"),
                    F.count(F.lit(1)).alias("n_hypotheses"))


def summary_table(df: DataFrame, code: str = "code", correct: str = "correct",
                  partial: str = "partial", pos: str = "pos") -> DataFrame:
    """E3 + E5 in one pass: per code and overall, ``n``, ``full``,
    ``partial`` and the first position where the code appears (the order
    of the report).  One grouping-set aggregation over the scored rows."""
    g = df.groupingSets([[code], []], code).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(correct).cast("double")).alias("full"),
        F.avg(F.col(partial).cast("double")).alias("partial"),
        F.min(pos).alias("first_pos"),
        F.grouping(code).alias("_g"))
    return g.select(
        code,
        F.when(F.col("_g") == 1, F.lit(OVERALL)).otherwise(F.col(code).cast("string")).alias("key"),
        (F.col("_g") == 1).alias("is_overall"), "n", "full", "partial", "first_pos")


def report_lines(summary: DataFrame) -> DataFrame:
    """The text report, one row per line with its line number.

    ``summary`` is a ``summary_table``.  Lines are
    ``     full <key right-aligned to 80>: 0.000`` for every key, then the
    same with ``  partial``; ``average`` comes first, then codes in order of
    first appearance.  A missing code prints as ``None``.  The table has one
    row per code, so numbering its lines is bounded by the number of codes.
    """
    def lines(label: str, col: str, block: int) -> DataFrame:
        return summary.select(
            F.lit(block).alias("block"), "is_overall", "first_pos",
            F.coalesce(F.col("key"), F.lit("None")).alias("key"),
            F.concat(F.format_string("%9s %80s: ", F.lit(label),
                                     F.coalesce(F.col("key"), F.lit("None"))),
                     format_exact(col, 3)).alias("line"))

    both = lines("full", "full", 0).unionByName(lines("partial", "partial", 1))
    from lexmetric.operators.sequence import with_position
    ranked = with_position(both, [F.col("block"), F.desc("is_overall"),
                                  F.col("first_pos").asc_nulls_last(), F.col("key")],
                           name="line_no", num_partitions=1)
    return ranked.select("line_no", "line")


def full_report(summary: DataFrame, model: str) -> DataFrame:
    """The whole text report of a run, one row per line.

    Three lines come before those of ``report_lines``: the model with its
    overall accuracy, the accuracy per code by name, and the same as a plain
    list, both in order of first appearance.  ``summary`` is a
    ``summary_table``; the lines are as long as there are codes.  Without rows
    the accuracy is ``nan`` and no code is listed.
    """
    # The shapes of the report's first lines.
    codes = F.array_sort(F.collect_list(F.when(~F.col("is_overall"), F.struct(
        F.col("first_pos").isNull().alias("last"), F.col("first_pos").alias("at"), "name", "shown"))))
    head = (summary.withColumn("shown", format_repr("full"))
            .withColumn("name", F.coalesce(F.col("key"), F.lit("None")))
            .agg(codes.alias("codes"),
                 F.coalesce(F.max(F.when(F.col("is_overall"), F.col("shown"))), F.lit("nan")).alias("all")))
    named = F.transform("codes", lambda s: F.concat(s["name"], F.lit(" : "), s["shown"]))
    first = F.array(
        F.concat(F.lit(f"Model : {model} ;  Accuracy : "), F.col("all")),
        F.concat(F.lit("Code type Accuracy : "), F.array_join(named, "  ;  ")),
        F.concat(F.lit("  acc: ["), F.array_join(F.transform("codes", lambda s: s["shown"]), ", "), F.lit("]")))
    opening = head.select(F.posexplode(first).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("long"))
    return opening.unionByName(report_lines(summary).withColumn("line_no", F.col("line_no") + 3))


def code_accuracy_line(by_code: DataFrame, code: str = "code") -> DataFrame:
    """``Code type Accuracy : a : 0.5  ;  b : 1.0`` (one row; its length
    is bounded by the number of codes).  Codes come in order of ``first_pos``
    when the table has it (see ``accuracy_by_code``), else by code."""
    # Fixed values here and in report_lines: the shapes of the report's lines.
    by = [F.col(c) for c in ("first_pos",) if c in by_code.columns] + [F.col(code).alias("k")]
    item = F.concat(F.coalesce(F.col(code).cast("string"), F.lit("None")), F.lit(" : "),
                    F.col("accuracy").cast("string"))
    return by_code.agg(F.concat(F.lit("Code type Accuracy : "), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(*by, item.alias("s")))),
                    lambda s: s["s"]), "  ;  ")).alias("line"))


def epoch_loss(log: DataFrame) -> DataFrame:
    """Mean of batch losses per (run, split, epoch), not row-weighted."""
    return log.groupBy("run", "split", "epoch").agg(
        F.avg("loss").alias("mean_loss"), F.sum("loss").alias("sum_loss"),
        F.count(F.lit(1)).alias("n_steps"))


def ensemble_logprob(cands: DataFrame, group: list[str], lprob: str = "lprob") -> DataFrame:
    """Log-mean-exp of log-probs over models, per group.

    ``m + ln(sum(exp(lp - m))) - ln(count)`` with ``m`` the group max; a group
    of nothing but ``-inf`` stays ``-inf``.  A group has a row per model, so
    the max is a window over the very shuffle the sum needs, and null keys are
    groups like any other.
    """
    w = Window.partitionBy(*group)
    rows = cands.select(*group, F.col(lprob).alias("_lp"), F.max(lprob).over(w).alias("_m"))
    m = F.first("_m")
    return rows.groupBy(*group).agg(
        F.when(m == F.lit(float("-inf")), m).otherwise(
            m + F.log(F.sum(F.exp(F.col("_lp") - F.col("_m")))) - F.log(F.count(F.lit(1)).cast("double"))
        ).alias("ensemble_lprob"),
        F.count(F.lit(1)).alias("n_models"))


def mean_attention(attn: DataFrame) -> DataFrame:
    """Attention averaged over heads, then over models."""
    per_model = attn.groupBy("sample_id", "model", "tgt_pos", "src_pos").agg(
        F.avg("attn").alias("attn"))
    return per_model.groupBy("sample_id", "tgt_pos", "src_pos").agg(F.avg("attn").alias("attn"))


def argmax_token(cands: DataFrame, group: list[str], token: str = "token_id",
                 score: str = "lprob") -> DataFrame:
    """Best token per group; ties go to the lowest id (run F11 first,
    since Spark sorts NaN highest)."""
    return cands.groupBy(*group).agg(
        F.max_by(token, F.struct(F.col(score), (-F.col(token)).alias("_neg"))).alias("best_token"),
        F.max(score).alias("best_score"))


def hard_alignment(attn: DataFrame, key: list[str], pad_src: list[int] | None = None,
                   src_token: str | None = None, skip_tokens: tuple[int, ...] = ()) -> DataFrame:
    """Best source position per target position (ties to the lowest
    source position), skipping pad / eos source tokens when ``src_token`` is
    given; one row per (key, tgt_pos)."""
    a = attn
    if src_token and skip_tokens:
        a = a.filter(~F.col(src_token).isin(*skip_tokens))
    return a.groupBy(*key, "tgt_pos").agg(
        F.max_by("src_pos", F.struct(F.col("attn"), (-F.col("src_pos")).alias("_neg"))).alias("src_pos"))


def render_alignment(aligned: DataFrame, key: list[str]) -> DataFrame:
    """``src-tgt`` pairs in target order, space-joined, per key (one
    hypothesis: bounded by its length)."""
    return aligned.groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("tgt_pos", "src_pos"))),
        lambda s: F.concat(s["src_pos"].cast("string"), F.lit("-"), s["tgt_pos"].cast("string"))),
        " ").alias("alignment"))
