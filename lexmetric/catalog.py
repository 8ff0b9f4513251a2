"""One registered query per operator, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
stand-in frames built from the driver's tables (whole tables, whole texts);
``ORACLE[name]`` is the same question in plain SQL.  Output columns carry the
same names and types on both sides; floating aggregates whose summation order
differs between engines are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmetric.functions.columns import STRIP_CLASS
from lexmetric import functions as C
from lexmetric import standins as S
from lexmetric.operators import metrics as E
from lexmetric.operators import ranking as R
from lexmetric.operators import shape as D
from lexmetric.operators import text as B
from lexmetric.operators import tokens as TK
from lexmetric.operators.sequence import running, with_position
from lexmetric.oracle import CTES, with_ctes
from lexmetric.session import shared_dir
from lexmetric.sources import codes as A_codes
from lexmetric.sources import files as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    """Round to 6 decimals as ``round(x * 1e6) / 1e6`` (ties away from zero on
    the binary value), the same rule DuckDB's ``round(x, 6)`` applies."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(1e6)) / F.lit(1e6)


def _mixed(sql: str) -> str:
    """The SQL of a query on ``scored``, asked of ``standins.mixed_scored``."""
    return sql.replace(with_ctes("scored"), with_ctes("preds", "codes", extra={
        "mixed": """
        SELECT p.* EXCLUDE (hyp_tokens, generated),
               CASE WHEN length(text) % 2 = 0 THEN tokens ELSE hyp_tokens END AS hyp_tokens,
               CASE WHEN length(text) % 2 = 0 THEN label ELSE generated END AS generated
        FROM preds p""",
        "scored": CTES["scored"].replace("FROM preds p", "FROM mixed p")}), 1)


# ---------------------------------------------------------------- flagship

def evaluation_summary(scored: DataFrame, code: str = "code") -> DataFrame:
    """Full (E3) and partial (E5) accuracy per code and overall in one pass."""
    g = scored.groupingSets([[code], []], code).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("full"),
        F.avg("partial").alias("partial"),
        F.grouping(code).alias("_g"))
    return g.select(
        F.when(F.col("_g") == 1, F.lit(E.OVERALL)).otherwise(F.col(code)).alias("key"),
        (F.col("_g") == 1).alias("is_overall"), "n", "full", r6("partial").alias("partial"))


@register("evaluation_summary", with_ctes("scored") + """
SELECT CASE WHEN GROUPING(code) = 1 THEN 'average' ELSE code END AS key,
       GROUPING(code) = 1 AS is_overall, count(*) AS n,
       avg(CAST(correct AS DOUBLE)) AS full, round(avg(partial), 6) AS partial
FROM scored GROUP BY GROUPING SETS ((code), ())""")
def q_evaluation_summary(spark, sf):
    return evaluation_summary(S.scored(spark, sf))


# ---------------------------------------------------------------- A: sources and sinks

@register("a1_read_samples", with_ctes("samples") + "SELECT text, label, sem_type FROM samples")
def q_a1(spark, sf):
    path = shared_dir(spark, "a1") + "/gen.tsv"
    A.write_headerless(S.samples(spark, sf), path)
    return A.read_samples(spark, path)


@register("a2_read_translated", with_ctes("localized") + """
SELECT pos AS idx, text, label, sem_type, language FROM localized""")
def q_a2(spark, sf):
    path = shared_dir(spark, "a2") + "/gen_translated.tsv"
    A.write_samples(_localized(spark, sf), path, compression="gzip")
    return A.read_translated(spark, path)


A3_SQL = with_ctes("localized") + r"""
, lines AS (
    SELECT unnest(string_split_regex(concat_ws(chr(9), CAST(pos AS VARCHAR), text, label, sem_type,
                                                language), '\r\n|\r|\n')) AS value
    FROM localized)
SELECT parts[1] AS idx, parts[2] AS text, parts[3] AS label, parts[4] AS sem_type,
       parts[5] AS language
FROM (SELECT string_split(value, chr(9)) AS parts, value
      FROM (SELECT regexp_replace(regexp_replace(value, '^@WS+', ''), '@WS+\z', '') AS value FROM lines))
WHERE len(parts) = 5 AND value <> 'idx' || chr(9) || 'text' || chr(9) || 'label' || chr(9)
      || 'sem_type' || chr(9) || 'language'""".replace("@WS", STRIP_CLASS)


@register("a3_read_strict_tsv", A3_SQL)
def q_a3(spark, sf):
    path = shared_dir(spark, "a3") + "/gen_translated.tsv"
    A.write_plain_tsv(_localized(spark, sf).withColumnRenamed("pos", "idx"), path, compression="gzip")
    good, _bad = A.read_strict_tsv(spark, path)
    return good


@register("a3_quarantined_lines", A3_SQL.split("SELECT parts[1]")[0] + """
SELECT value AS raw, CAST(len(string_split(value, chr(9))) AS INTEGER) AS n_fields
FROM (SELECT regexp_replace(regexp_replace(value, '^@WS+', ''), '@WS+\\z', '') AS value FROM lines)
WHERE len(string_split(value, chr(9))) <> 5""".replace("@WS", STRIP_CLASS))
def q_a3_bad(spark, sf):
    path = shared_dir(spark, "a3") + "/gen_translated.tsv"
    A.write_plain_tsv(_localized(spark, sf).withColumnRenamed("pos", "idx"), path, compression="gzip")
    _good, bad = A.read_strict_tsv(spark, path)
    return bad


@register("a4_scan_dir", with_ctes("localized") + """
SELECT pos AS idx, text, label, sem_type, language FROM localized""")
def q_a4(spark, sf):
    base = shared_dir(spark, "a4")
    A.write_headerless(S.samples(spark, sf), f"{base}/gen.tsv")
    A.write_samples(_localized(spark, sf), f"{base}/gen_translated.tsv", compression="gzip")
    A.write_headerless(S.samples(spark, sf), f"{base}/dev.tsv")
    return A.scan_dir(spark, base, "translated", A.read_translated).drop("source_file")


def _newline_free(c: str) -> F.Column:
    return F.regexp_replace(F.col(c), r"[\r\n]", " ")


@register("a5_read_parallel_lines", with_ctes("pairs") + r"""
SELECT pos, regexp_replace(src, '[\r\n]', ' ', 'g') AS src, regexp_replace(tgt, '[\r\n]', ' ', 'g') AS tgt
FROM pairs""")
def q_a5(spark, sf):
    base = shared_dir(spark, "a5")
    pairs = S.conversation_pairs(spark, sf)
    A.write_lines(pairs.select("pos", _newline_free("src").alias("line")), f"{base}/train.src")
    A.write_lines(pairs.select("pos", _newline_free("tgt").alias("line")), f"{base}/train.tgt")
    return A.read_parallel_lines(spark, [f"{base}/train.src", f"{base}/train.tgt"], ["src", "tgt"])


@register("a6_attach_codes", with_ctes("samples", "codes") + """
SELECT s.sample_id, c.code FROM samples s LEFT JOIN codes c USING (pos)""")
def q_a6(spark, sf):
    return A_codes.attach_codes(S.samples(spark, sf), S.codes(spark, sf)).select("sample_id", "code")


@register("a6_read_codes", with_ctes("samples", "codes") + """
, n AS (SELECT code, row_number() OVER (ORDER BY pos) - 1 AS line_no FROM codes)
, s AS (SELECT sample_id, row_number() OVER (ORDER BY pos) - 1 AS line_no FROM samples)
SELECT sample_id, code FROM s LEFT JOIN n USING (line_no)""")
def q_a6b(spark, sf):
    """The side file holds a code per line; samples past its end have none."""
    path = shared_dir(spark, "a6") + "/test.word-predicate.code"
    A.write_lines(S.codes(spark, sf), path, line="code")
    numbered = with_position(S.samples(spark, sf).select("sample_id", "pos"), ["pos"], name="line_no")
    codes = A_codes.read_codes(spark, path, pos="line_no")
    return A_codes.attach_codes(numbered, codes, pos="line_no").select("sample_id", "code")


@register("a7_write_samples", with_ctes("localized") + """
SELECT CAST(pos AS VARCHAR) AS _c0, text, label, sem_type, language FROM localized""")
def q_a7(spark, sf):
    path = shared_dir(spark, "a7") + "/gen_translated.tsv"
    A.write_samples(_localized(spark, sf), path, compression="gzip")
    schema = "_c0 STRING, text STRING, label STRING, sem_type STRING, language STRING"
    return (spark.read.schema(schema).options(**A._TSV, nullValue="\x00").option("header", "true").csv(path))


@register("a8_prediction_batches", with_ctes("preds") + """
SELECT pos // 32 AS batch_id, text, label, generated, pos FROM preds""")
def q_a8(spark, sf):
    path = shared_dir(spark, "a8") + "/predictions.jsonl"
    preds = D.batches(S.predictions(spark, sf), 32)
    A.write_prediction_batches(preds, path, compression="gzip")
    return A.read_prediction_batches(spark, path)


@register("a8_growing_predictions", with_ctes("preds") + """
SELECT pos // 256 AS batch_id, text, label, generated, pos FROM preds""")
def q_a8b(spark, sf):
    path = shared_dir(spark, "a8-growing") + "/predictions.jsonl"
    preds = D.batches(S.predictions(spark, sf), 256)
    A.write_prediction_batches(preds, path, cumulative=True)
    return A.read_prediction_batches(spark, path, cumulative=True)


A9_SQL = with_ctes("encoded") + """
SELECT pos, '"' || trim(translate('[' || array_to_string(ids, ', ') || ']', '[],', '')) || '"' AS line
FROM encoded"""


@register("a9_write_encoded", A9_SQL)
def q_a9(spark, sf):
    path = shared_dir(spark, "a9") + "/gen.bpe"
    enc = _encoded(spark, sf).select("pos", C.clean_id_string(C.list_repr("ids")).alias("line"))
    A.write_encoded(enc, path)
    return A.read_lines(spark, path)


def _report(spark, sf) -> DataFrame:
    return E.report_lines(E.summary_table(S.scored(spark, sf)))


REPORT_SQL = with_ctes("scored") + """
, t AS (
    SELECT CASE WHEN GROUPING(code) = 1 THEN 'average' ELSE coalesce(code, 'None') END AS key,
           GROUPING(code) = 1 AS is_overall, min(pos) AS first_pos,
           avg(CAST(correct AS DOUBLE)) AS full_v, avg(partial) AS partial_v
    FROM scored GROUP BY GROUPING SETS ((code), ())),
lines AS (
    SELECT 0 AS block, is_overall, first_pos, key, printf('%9s %80s: %.3f', 'full', key, full_v) AS line FROM t
    UNION ALL
    SELECT 1, is_overall, first_pos, key, printf('%9s %80s: %.3f', 'partial', key, partial_v) FROM t)
SELECT row_number() OVER (ORDER BY block, is_overall DESC, first_pos NULLS LAST, key) - 1 AS line_no,
       line
FROM lines"""


@register("a10_write_report", REPORT_SQL)
def q_a10(spark, sf):
    path = shared_dir(spark, "a10") + "/generate-test.txt"
    A.write_report(_report(spark, sf), path)
    return A.read_lines(spark, path, value="line", pos="line_no")


MODEL = "checkpoint_last.pt"

FULL_REPORT_SQL = REPORT_SQL.replace("SELECT row_number()", f""",
c AS (SELECT * FROM t WHERE NOT is_overall)
SELECT 0 AS line_no, 'Model : {MODEL} ;  Accuracy : ' || CAST(full_v AS VARCHAR) AS line FROM t WHERE is_overall
UNION ALL
SELECT 1, 'Code type Accuracy : ' || string_agg(key || ' : ' || CAST(full_v AS VARCHAR), '  ;  ' ORDER BY first_pos)
FROM c
UNION ALL
SELECT 2, '  acc: [' || string_agg(CAST(full_v AS VARCHAR), ', ' ORDER BY first_pos) || ']' FROM c
UNION ALL
SELECT 3 + row_number()""")


@register("a10_full_report", _mixed(FULL_REPORT_SQL))
def q_a10b(spark, sf):
    path = shared_dir(spark, "a10") + "/generate-test.txt"
    A.write_report(E.full_report(E.summary_table(S.mixed_scored(spark, sf)), MODEL), path)
    return A.read_lines(spark, path, value="line", pos="line_no")


@register("a11_rebuild_output", with_ctes("localized") + """
SELECT sample_id, pos, text, label, sem_type, language FROM localized""")
def q_a11(spark, sf):
    path = shared_dir(spark, "a11") + "/prepared"
    A.rebuild_output(S.samples(spark, sf).select("sample_id", "pos", "text"), path)
    A.rebuild_output(_localized(spark, sf), path)
    return spark.read.parquet(path).select("sample_id", "pos", "text", "label", "sem_type", "language")


@register("a12_read_vectors_text", with_ctes("vecs") + "SELECT 'v' || CAST(vec_id AS VARCHAR) AS token, vec FROM vecs")
def q_a12(spark, sf):
    path = shared_dir(spark, "a12") + "/vectors.txt"
    vecs = S.vectors(spark, sf).select(F.concat(F.lit("v"), F.col("vec_id")).alias("token"), "vec")
    A.write_vectors_text(vecs, path)
    return A.read_vectors_text(spark, path, 64)


# ---------------------------------------------------------------- B: projections, filters, scalars

@register("b1_project", with_ctes("samples") + "SELECT text, label, sem_type FROM samples")
def q_b1(spark, sf):
    return B.project(S.samples(spark, sf), ["text", "label", "sem_type"])


@register("b2_strip_text", r"""
SELECT doc_id AS sample_id,
       regexp_replace(regexp_replace(text, '^[\t\n\x0B\f\r ]+', ''), '[\t\n\x0B\f\r ]+\z', '') AS text
FROM documents""")
def q_b2(spark, sf):
    docs = S.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("sample_id"), C.strip_text("text").alias("text"))


B3_SQL = with_ctes("pairs") + r"""
SELECT pos, src, tgt,
       CASE WHEN coalesce(regexp_replace(regexp_replace(src, '^[\t\n\x0B\f\r ]+', ''), '[\t\n\x0B\f\r ]+\z', '') = '', true)
              OR coalesce(regexp_replace(regexp_replace(tgt, '^[\t\n\x0B\f\r ]+', ''), '[\t\n\x0B\f\r ]+\z', '') = '', true)
            THEN 'EMPTY' ELSE 'PASS' END AS outcome
FROM pairs"""


@register("b3_tag_empty", B3_SQL)
def q_b3(spark, sf):
    pairs = S.conversation_pairs(spark, sf)
    return B.tag_empty(pairs, ["src", "tgt"], keep_empty=True).select("pos", "src", "tgt", "outcome")


@register("b3_drop_empty", "SELECT * FROM (" + B3_SQL + ") WHERE outcome = 'PASS'")
def q_b3b(spark, sf):
    pairs = S.conversation_pairs(spark, sf)
    return B.tag_empty(pairs, ["src", "tgt"]).select("pos", "src", "tgt", "outcome")


@register("b4_clean_id_string", with_ctes("encoded") + """
SELECT sample_id, '"' || trim(translate('[' || array_to_string(ids, ', ') || ']', '[],', '')) || '"' AS cleaned
FROM encoded""")
def q_b4(spark, sf):
    return _encoded(spark, sf).select("sample_id", C.clean_id_string(C.list_repr("ids")).alias("cleaned"))


@register("b5_ids_to_string", with_ctes("encoded") + """
SELECT sample_id, array_to_string(ids, ' ') AS ids_text FROM encoded""")
def q_b5(spark, sf):
    return _encoded(spark, sf).select("sample_id", C.ids_to_string("ids").alias("ids_text"))


# The character map of the B6 / J2 stand-in rewrite (accents off).
ACCENTED = "éèêëàâçîïôûù"
PLAIN = "eeeeaaciiouu"


@register("b6_apply_by_language", with_ctes("samples") + f"""
SELECT sample_id, language,
       CASE WHEN language = 'fr' THEN translate(text, '{ACCENTED}', '{PLAIN}') ELSE text END AS text
FROM samples""")
def q_b6(spark, sf):
    out = B.apply_by_language(S.samples(spark, sf), "fr", lambda c: F.translate(c, ACCENTED, PLAIN))
    return out.select("sample_id", "language", "text")


@register("b7_preview", with_ctes("samples") + "SELECT pos, text FROM samples ORDER BY pos LIMIT 7")
def q_b7(spark, sf):
    return B.preview(S.samples(spark, sf), 7).select("pos", "text")


@register("b8_filter_by_length", with_ctes("preds") + """
SELECT sample_id, CAST(len(ref_tokens) AS INTEGER) AS n_src, CAST(len(hyp_tokens) AS INTEGER) AS n_tgt
FROM preds WHERE len(ref_tokens) <= 128 AND len(hyp_tokens) <= 128""")
def q_b8(spark, sf):
    p = S.predictions(spark, sf)
    kept = B.filter_by_length(p, 128, 128, src="ref_tokens", tgt="hyp_tokens")
    return kept.select("sample_id", F.size("ref_tokens").alias("n_src"), F.size("hyp_tokens").alias("n_tgt"))


@register("b9_output_length_limit", with_ctes("samples") + """
, l AS (SELECT sample_id, pos // 64 AS batch_id, len(tokens) AS src_len FROM samples)
SELECT sample_id, CAST(least(floor(1.5 * src_len + 10), 1023) AS BIGINT) AS max_len,
       CAST(max(src_len) OVER (PARTITION BY batch_id) AS BIGINT) AS match_max_len
FROM l""")
def q_b9(spark, sf):
    s = D.batches(S.samples(spark, sf), 64).withColumn("src_len", F.size("tokens"))
    batch_max = s.groupBy("batch_id").agg(F.max("src_len").alias("_bm"))
    s = s.join(batch_max, "batch_id")
    return s.select("sample_id",
                    C.output_length_limit("src_len", 1.5, 10, 1024, min_len=1).alias("max_len"),
                    C.output_length_limit("_bm", 1.5, 10, 1024, match=True).alias("match_max_len"))


@register("b10_source_length", with_ctes("samples") + """
SELECT sample_id, CAST(len(tokens) AS INTEGER) AS src_len FROM samples""")
def q_b10(spark, sf):
    enc = _encoded(spark, sf).withColumn("ids", C.append_token("ids", TK.EOS))
    enc = TK.pad(enc, "ids", TK.PAD, length=512)
    return enc.select("sample_id", C.source_length("ids", TK.PAD, TK.EOS).alias("src_len"))


@register("b11_to_log2", with_ctes("hyps") + f"""
SELECT sample_id, beam, tie1, tie2, round(score / {math.log(2.0)!r}, 6) AS score_log2,
       printf('%.4f', score / {math.log(2.0)!r}) AS rendered
FROM hyps""")
def q_b11(spark, sf):
    h = S.hypotheses(spark, sf)
    return h.select("sample_id", "beam", "tie1", "tie2", r6(C.to_log2("score")).alias("score_log2"),
                    C.format_fixed(C.to_log2("score"), 4).alias("rendered"))


@register("b11_render_scores", with_ctes("hyps") + f"""
SELECT sample_id, array_to_string(list(printf('%.4f', score / {math.log(2.0)!r}) ORDER BY score DESC), ' ') AS rendered
FROM hyps GROUP BY sample_id""")
def q_b11b(spark, sf):
    # An order holds at most seven lines, so its list of scores is bounded.
    per = S.hypotheses(spark, sf).groupBy("sample_id").agg(
        F.sort_array(F.collect_list(C.to_log2("score")), asc=False).alias("scores"))
    return per.select("sample_id", C.render_scores("scores").alias("rendered"))


# ---------------------------------------------------------------- C: tokens and arrays

def _vocab(spark, sf) -> DataFrame:
    return TK.build_vocab(S.samples(spark, sf), "tokens")


def _encoded(spark, sf, vocab: DataFrame | None = None) -> DataFrame:
    vocab = vocab if vocab is not None else _vocab(spark, sf)
    return TK.encode(S.samples(spark, sf), vocab, "tokens", "ids", keep=["pos"])


def _localized(spark, sf) -> DataFrame:
    expanded = D.expand_languages(S.samples(spark, sf).drop("tokens"))
    return D.localize(expanded, S.translation_memory(spark, sf)).select(
        "sample_id", "pos", "text", "label", "sem_type", "language")


@register("c1_tokenize", with_ctes("samples") + "SELECT sample_id, tokens FROM samples")
def q_c1(spark, sf):
    return TK.tokenize(S.table(spark, sf, "documents").withColumnRenamed("doc_id", "sample_id")).select(
        "sample_id", "tokens")


@register("c1_tokenize_max512", with_ctes("samples") + "SELECT sample_id, list_slice(tokens, 1, 512) AS tokens FROM samples")
def q_c1b(spark, sf):
    docs = S.table(spark, sf, "documents").withColumnRenamed("doc_id", "sample_id")
    return TK.tokenize(docs, max_len=512).select("sample_id", "tokens")


@register("c2_build_vocab", with_ctes("vocab") + "SELECT token_id, token, n, is_special FROM vocab")
def q_c2(spark, sf):
    return _vocab(spark, sf)


@register("c3_encode", with_ctes("encoded") + "SELECT sample_id, ids FROM encoded")
def q_c3(spark, sf):
    return _encoded(spark, sf).select("sample_id", "ids")


@register("c4_pad", with_ctes("encoded") + """
SELECT sample_id, CAST(greatest(len(ids), 512) AS INTEGER) AS padded_len,
       md5(array_to_string(list_concat(ids, list_transform(range(greatest(512 - len(ids), 0)), lambda x: 1)), ',')) AS padded
FROM encoded""")
def q_c4(spark, sf):
    padded = TK.pad(_encoded(spark, sf), "ids", TK.PAD, out="padded", length=512)
    return padded.select("sample_id", F.size("padded").alias("padded_len"),
                         F.md5(C.ids_to_string("padded", ",")).alias("padded"))


@register("c4_pad_left", with_ctes("encoded") + """
SELECT sample_id,
       md5(array_to_string(list_concat(list_transform(range(greatest(512 - len(ids), 0)), lambda x: 1), ids), ',')) AS padded
FROM encoded""")
def q_c4b(spark, sf):
    padded = TK.pad(_encoded(spark, sf), "ids", TK.PAD, out="padded", length=512, left=True)
    return padded.select("sample_id", F.md5(C.ids_to_string("padded", ",")).alias("padded"))


@register("c5_strip_pad", with_ctes("encoded") + "SELECT sample_id, ids FROM encoded")
def q_c5(spark, sf):
    padded = TK.pad(_encoded(spark, sf), "ids", TK.PAD, length=512)
    return padded.select("sample_id", C.strip_pad("ids", TK.PAD).alias("ids"))


@register("c6_padding_mask", with_ctes("encoded") + """
SELECT sample_id, repeat('0', len(ids)) || repeat('1', greatest(512 - len(ids), 0)) AS mask
FROM encoded""")
def q_c6(spark, sf):
    padded = TK.pad(_encoded(spark, sf), "ids", TK.PAD, length=512).withColumn("mask", C.padding_mask("ids", TK.PAD))
    return padded.select("sample_id", F.array_join(F.transform(
        "mask", lambda m: F.when(m, "1").otherwise("0")), "").alias("mask"))


@register("c7_decode", with_ctes("samples", "vocab", "exploded") + """
SELECT s.sample_id, coalesce(d.decoded, '') AS decoded
FROM samples s LEFT JOIN (
    SELECT x.sample_id, string_agg(x.token, ' ' ORDER BY x.p) AS decoded
    FROM exploded x JOIN vocab v ON x.token = v.token AND NOT v.is_special
    GROUP BY x.sample_id) d USING (sample_id)""")
def q_c7(spark, sf):
    vocab = _vocab(spark, sf)
    return TK.decode(_encoded(spark, sf, vocab), vocab, keep=[]).select("sample_id", "decoded")


@register("c7_decode_escape_unk", with_ctes("samples", "vocab", "exploded") + """
SELECT s.sample_id, coalesce(d.decoded, '') AS decoded
FROM samples s LEFT JOIN (
    SELECT x.sample_id, string_agg(coalesce(v.token, '<<unk>>'), ' ' ORDER BY x.p) AS decoded
    FROM exploded x LEFT JOIN vocab v ON x.token = v.token AND NOT v.is_special
    GROUP BY x.sample_id) d USING (sample_id)""")
def q_c7b(spark, sf):
    vocab = _vocab(spark, sf)
    return TK.decode(_encoded(spark, sf, vocab), vocab, skip_specials=False,
                     escape_unk=True, keep=[]).select("sample_id", "decoded")


@register("c8_edit_tokens", with_ctes("samples") + """
SELECT sample_id, md5(array_to_string(list_concat(tokens, ['<sep>']), ' ')) AS appended,
       md5(coalesce(array_to_string(list_slice(tokens, 2, len(tokens)), ' '), '')) AS dropped_first,
       list_slice(tokens, 1, 3) AS prefix3,
       md5(coalesce(array_to_string(list_slice(tokens, 3, len(tokens)), ' '), '')) AS from_offset2
FROM samples""")
def q_c8(spark, sf):
    s = S.samples(spark, sf)
    digest = lambda c: F.md5(F.array_join(c, " "))
    return s.select("sample_id", digest(C.append_token("tokens", "<sep>")).alias("appended"),
                    digest(C.drop_first("tokens")).alias("dropped_first"),
                    C.take_prefix("tokens", 3).alias("prefix3"),
                    digest(C.from_offset("tokens", 2)).alias("from_offset2"))


@register("c9_collate", with_ctes("encoded") + """
, b AS (SELECT sample_id, pos // 64 AS batch_id, list_concat(ids, [2]) AS ids FROM encoded)
, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS widest FROM b)
SELECT sample_id, batch_id, md5(array_to_string(list_concat([2], list_slice(ids, 1, len(ids) - 1),
       list_transform(range(widest - len(ids)), lambda x: 1)), ',')) AS row_ids
FROM m""")
def q_c9(spark, sf):
    enc = D.batches(_encoded(spark, sf), 64).withColumn("ids", C.append_token("ids", TK.EOS))
    col = TK.collate(enc, "ids", "batch_id", TK.PAD, TK.EOS, move_eos_to_front=True)
    return col.select("sample_id", "batch_id", F.md5(C.ids_to_string("ids", ",")).alias("row_ids"))


@register("c10_unknown_markers", with_ctes("vocab") + """
SELECT token_id, token FROM vocab WHERE contains(token, '<unk>')""")
def q_c10(spark, sf):
    return TK.unknown_markers(_vocab(spark, sf)).select("token_id", "token")


@register("c10_unknown_rate", with_ctes("encoded") + """
SELECT sample_id, CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda x: x = 3)) / len(ids) END AS unk_rate
FROM encoded""")
def q_c10b(spark, sf):
    return TK.unknown_rate(_encoded(spark, sf)).select("sample_id", "unk_rate")


# A vocabulary of the conversations alone knows less than half of the documents' words.
TALK_SQL = with_ctes("samples") + r"""
, w AS (SELECT unnest(string_split_regex(text, '[\t\n\x0B\f\r ]+')) AS token FROM conversations)
, v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS token_id FROM w
        WHERE token NOT IN ('', '<s>', '<pad>', '</s>', '<unk>') GROUP BY token)
, x AS (SELECT sample_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM samples)
, e AS (SELECT x.sample_id, list(coalesce(v.token_id, 3) ORDER BY x.p) AS ids
        FROM x LEFT JOIN v USING (token) GROUP BY x.sample_id)
"""


def _encoded_by_talk(spark, sf) -> tuple[DataFrame, DataFrame]:
    talk = S.table(spark, sf, "conversations").select(C.words("text").alias("tokens"))
    vocab = TK.build_vocab(talk, "tokens")
    return _encoded(spark, sf, vocab), vocab


@register("c3_encode_unknown", TALK_SQL + """
SELECT sample_id, coalesce(md5(array_to_string(ids, ',')), md5('')) AS ids_md5
FROM samples LEFT JOIN e USING (sample_id)""")
def q_c3b(spark, sf):
    return _encoded_by_talk(spark, sf)[0].select("sample_id", F.md5(C.ids_to_string("ids", ",")).alias("ids_md5"))


@register("c10_unknown_rate_of_new_words", TALK_SQL + """
SELECT sample_id, CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda x: x = 3)) / len(ids) END AS unk_rate
FROM samples LEFT JOIN e USING (sample_id)""")
def q_c10c(spark, sf):
    return TK.unknown_rate(_encoded_by_talk(spark, sf)[0]).select("sample_id", "unk_rate")


@register("c7_decode_new_words", TALK_SQL + """
, d AS (SELECT x.sample_id, string_agg(CASE WHEN v.token IS NULL THEN '<<unk>>' ELSE x.token END, ' ' ORDER BY x.p) AS text
        FROM x LEFT JOIN v USING (token) GROUP BY x.sample_id)
SELECT sample_id, md5(coalesce(d.text, '')) AS text_md5 FROM samples LEFT JOIN d USING (sample_id)""")
def q_c7c(spark, sf):
    ids, vocab = _encoded_by_talk(spark, sf)
    return TK.decode(ids, vocab, "ids", "decoded", skip_specials=False, escape_unk=True).select(
        "sample_id", F.md5("decoded").alias("text_md5"))


@register("c11_l2_normalize", with_ctes("vecs") + """
SELECT vec_id, list_transform(vec, lambda x: round(x / greatest(sqrt(list_reduce(list_transform(vec, lambda y: y * y), lambda a, b: a + b)), 1e-12), 6)) AS unit
FROM vecs""")
def q_c11(spark, sf):
    v = S.vectors(spark, sf)
    return v.select("vec_id", F.transform(C.l2_normalize("vec"), r6).alias("unit"))


@register("c12_embed_tokens", with_ctes("encoded") + """
, x AS (SELECT sample_id, unnest(ids) AS token_id FROM encoded)
SELECT e.sample_id, CAST(len(e.ids) AS INTEGER) AS n_vectors,
       round(coalesce(s.total, 0.0), 6) AS checksum
FROM encoded e LEFT JOIN (
    SELECT x.sample_id, sum(CASE WHEN x.token_id = 1 THEN 0.0 ELSE 8.0 * v.s END) AS total
    FROM x LEFT JOIN (SELECT vec_id, list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) AS s
                      FROM embeddings) v ON v.vec_id = x.token_id
    GROUP BY x.sample_id) s USING (sample_id)""")
def q_c12(spark, sf):
    vecs = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("token_id"),
        F.transform("embedding", lambda y: y.cast("double")).alias("vec"))
    emb = TK.embed_tokens(_encoded(spark, sf), vecs, "ids", scale=math.sqrt(64), dim=64, keep=[])
    total = F.aggregate(emb["vectors"], F.lit(0.0).cast("double"),
                        lambda acc, v: acc + F.aggregate(v, F.lit(0.0).cast("double"), lambda a, y: a + y))
    return emb.select("sample_id", F.size("vectors").alias("n_vectors"), r6(total).alias("checksum"))


# Vectors of whole numbers (sums of eight floored values), so both engines add them exactly.
@register("c12_embed_pieces", with_ctes("encoded") + """
, w AS (SELECT vec_id, list_transform(range(8), lambda k: 8.0::DOUBLE * list_sum(list_transform(
            list_slice(embedding, k * 8 + 1, k * 8 + 8), lambda y: floor(CAST(y AS DOUBLE) * 1000)))) AS vec
        FROM embeddings),
x AS (SELECT sample_id, unnest(ids) AS token_id, generate_subscripts(ids, 1) - 1 AS p FROM encoded)
SELECT x.sample_id, CAST(x.p // 128 AS INTEGER) AS piece,
       list(CASE WHEN x.token_id = 1 OR w.vec IS NULL THEN list_transform(range(8), lambda k: 0.0::DOUBLE) ELSE w.vec END
            ORDER BY x.p) AS vectors
FROM x LEFT JOIN w ON w.vec_id = x.token_id GROUP BY x.sample_id, x.p // 128""")
def q_c12b(spark, sf):
    scaled = F.transform("embedding", lambda y: F.floor(y.cast("double") * 1000).cast("double"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(
        F.slice(scaled, k * 8 + 1, 8), F.lit(0.0), lambda a, y: a + y))
    vecs = S.table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("token_id"), sums.alias("vec"))
    return TK.embed_pieces(_encoded(spark, sf), vecs, "ids", piece=128, scale=8.0, dim=8)


@register("c13_vocab_with_vectors", with_ctes("vocab") + """
SELECT v.token_id, v.token, w.token IS NOT NULL AS has_vector
FROM vocab v LEFT JOIN (SELECT u.token FROM embeddings e
                        JOIN vocab u ON u.token_id = e.vec_id) w ON w.token = v.token""")
def q_c13(spark, sf):
    vocab = _vocab(spark, sf)
    vecs = S.vectors(spark, sf).join(
        vocab.select(F.col("token_id").cast("long").alias("vec_id"), "token"), "vec_id")
    return TK.vocab_with_vectors(vocab, vecs).select("token_id", "token", "has_vector")


NGRAMS_SQL = """
, g AS (SELECT sample_id, unnest(list_transform(range(1, len(tokens) - 1),
                                                lambda i: list_slice(tokens, i, i + 2))) AS ngram
        FROM samples WHERE len(tokens) >= 3)"""


@register("c14_repeated_ngrams", with_ctes("samples") + NGRAMS_SQL + """
SELECT sample_id, ngram, count(*) AS n FROM g GROUP BY sample_id, ngram HAVING count(*) > 1""")
def q_c14(spark, sf):
    return TK.repeated_ngrams(S.samples(spark, sf), 3)


@register("c14_repeated_8grams", with_ctes("samples") + NGRAMS_SQL.replace("len(tokens) - 1", "len(tokens) - 6")
          .replace("i + 2", "i + 7").replace(">= 3", ">= 8") + """
SELECT sample_id, ngram, count(*) AS n FROM g GROUP BY sample_id, ngram HAVING count(*) > 1""")
def q_c14e(spark, sf):
    return TK.repeated_ngrams(S.samples(spark, sf), 8)


@register("c14_ngram_continuations", with_ctes("samples") + NGRAMS_SQL + """
SELECT sample_id, list_slice(ngram, 1, 2) AS prefix, list_sort(list(DISTINCT ngram[3])) AS continuations
FROM g GROUP BY sample_id, list_slice(ngram, 1, 2)""")
def q_c14b(spark, sf):
    return TK.ngram_continuations(S.samples(spark, sf), 3)


@register("c14_banned_next_tokens", with_ctes("samples") + NGRAMS_SQL + """
SELECT DISTINCT s.sample_id, g.ngram[3] AS token
FROM samples s JOIN g ON g.sample_id = s.sample_id
 AND list_slice(g.ngram, 1, 2) = list_slice(s.tokens, len(s.tokens) - 1, len(s.tokens))
WHERE len(s.tokens) >= 2""")
def q_c14c(spark, sf):
    return TK.banned_next_tokens(S.samples(spark, sf), 3)


@register("c14_ban_tokens", with_ctes("samples") + NGRAMS_SQL + """
, c AS (SELECT sample_id, token, count(*) AS n
        FROM (SELECT sample_id, unnest(tokens) AS token FROM samples) GROUP BY ALL),
b AS (SELECT DISTINCT s.sample_id, g.ngram[3] AS token
      FROM samples s JOIN g ON g.sample_id = s.sample_id
       AND list_slice(g.ngram, 1, 2) = list_slice(s.tokens, len(s.tokens) - 1, len(s.tokens))
      WHERE len(s.tokens) >= 2)
SELECT c.sample_id, c.token,
       CASE WHEN b.token IS NULL THEN -1.0::DOUBLE / c.n ELSE '-Infinity'::DOUBLE END AS lprob
FROM c LEFT JOIN b ON b.sample_id = c.sample_id AND b.token = c.token""")
def q_c14d(spark, sf):
    """Every word of a sample is a candidate; those that would repeat a trigram score -inf."""
    s = S.samples(spark, sf)
    cands = (s.select("sample_id", F.explode("tokens").alias("token")).groupBy("sample_id", "token")
             .agg((F.lit(-1.0) / F.count(F.lit(1))).alias("lprob")))
    return TK.ban_tokens(cands, TK.banned_next_tokens(s, 3))


@register("c15_expand_prefixes", with_ctes("samples") + """
SELECT sample_id, prefix_len,
       list_concat(list_concat([language, sem_type], list_slice(tokens, greatest(prefix_len - 2, 1), prefix_len)), ['</s>']) AS tokens
FROM (SELECT sample_id, language, sem_type, tokens, CAST(unnest(range(1, len(tokens) + 1)) AS INTEGER) AS prefix_len
      FROM samples WHERE len(tokens) > 0)""")
def q_c15(spark, sf):
    s = S.samples(spark, sf).withColumn("src_tokens", F.array("language", "sem_type"))
    return TK.expand_prefixes(s, "src_tokens", "tokens", horizon=3, end="</s>")


# ---------------------------------------------------------------- D: joins and shaping

@register("d1_expand_languages", with_ctes("expanded") + """
SELECT sample_id, pos, language FROM expanded""")
def q_d1(spark, sf):
    return D.expand_languages(S.samples(spark, sf)).select("sample_id", "pos", "language")


@register("d2_localize", with_ctes("localized") + """
SELECT sample_id, pos, language, text, label, sem_type FROM localized""")
def q_d2(spark, sf):
    return _localized(spark, sf).select("sample_id", "pos", "language", "text", "label", "sem_type")


@register("d3_pending_translations", with_ctes("expanded", "memory") + """
SELECT DISTINCT e.text, e.language FROM expanded e
WHERE e.language <> 'en'
  AND NOT EXISTS (SELECT 1 FROM memory m WHERE m.src_text = e.text AND m.language = e.language)""")
def q_d3(spark, sf):
    expanded = D.expand_languages(S.samples(spark, sf))
    return D.pending_translations(expanded, S.translation_memory(spark, sf))


@register("d4_with_position", """
SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents""")
def q_d4(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", "n_chars")
    return with_position(docs, ["n_chars", "doc_id"])


@register("d5_rotating_sample", with_ctes("localized") + """
SELECT sample_id, pos, language, text FROM localized
WHERE language = list_element(['fr', 'es', 'ar', 'de', 'en', 'ja'], CAST(((pos + 1) // 6) % 6 AS INTEGER) + 1)""")
def q_d5(spark, sf):
    return D.rotating_sample(_localized(spark, sf)).select("sample_id", "pos", "language", "text")


@register("d5_balanced_sample", with_ctes("localized") + """
SELECT sample_id, pos, language, text FROM localized
WHERE language = list_element(['fr', 'es', 'ar', 'de', 'en', 'ja'], CAST((pos // 6) % 6 AS INTEGER) + 1)""")
def q_d5b(spark, sf):
    return D.rotating_sample(_localized(spark, sf), mode="balanced").select(
        "sample_id", "pos", "language", "text")


@register("d6_replicate", with_ctes("samples") + """
SELECT sample_id, CAST(unnest(range(0, 5)) AS INTEGER) AS copy FROM samples""")
def q_d6(spark, sf):
    return D.replicate(S.samples(spark, sf), 5).select("sample_id", "copy")


@register("d7_batches", with_ctes("samples") + "SELECT sample_id, pos // 64 AS batch_id FROM samples")
def q_d7(spark, sf):
    return D.batches(S.samples(spark, sf), 64).select("sample_id", "batch_id")


@register("d7_batches_shuffled", with_ctes("samples") + """
SELECT sample_id, CAST((row_number() OVER (ORDER BY md5('7:' || sample_id), sample_id) - 1) // 64 AS BIGINT) AS batch_id
FROM samples""")
def q_d7_shuffled(spark, sf):
    return D.batches(S.samples(spark, sf), 64, shuffle=True, seed=7).select("sample_id", "batch_id")


@register("d8_token_budget_batches", with_ctes("samples") + """
SELECT * FROM (
  WITH RECURSIVE sized AS (
    SELECT sample_id, len(tokens) AS n,
           CASE WHEN len(tokens) <= 1 THEN 0 ELSE length(bin(len(tokens) - 1)) END AS bucket
    FROM samples),
  placed AS (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n, sample_id) AS r FROM sized),
  packed AS (
    SELECT bucket, r, sample_id, n, 0 AS k, 1 AS held FROM placed WHERE r = 1
    UNION ALL
    SELECT q.bucket, q.r, q.sample_id, q.n,
           CASE WHEN p.held + 1 > 100 OR (p.held + 1) * q.n > 4096 THEN p.k + 1 ELSE p.k END,
           CASE WHEN p.held + 1 > 100 OR (p.held + 1) * q.n > 4096 THEN 1 ELSE p.held + 1 END
    FROM packed p JOIN placed q ON q.bucket = p.bucket AND q.r = p.r + 1)
  SELECT sample_id, CAST(n AS INTEGER) AS n_tokens, bucket || '-' || k AS batch_id FROM packed)""")
def q_d8(spark, sf):
    s = S.samples(spark, sf).withColumn("n_tokens", F.size("tokens"))
    packed = D.token_budget_batches(s, max_tokens=4096, max_sentences=100)
    return packed.select("sample_id", "n_tokens", "batch_id")


@register("d9_shard", with_ctes("samples") + "SELECT sample_id, pos FROM samples WHERE pos % 4 = 1")
def q_d9(spark, sf):
    return D.shard(S.samples(spark, sf), 4, 1).select("sample_id", "pos")


@register("d10_pair_predictions", with_ctes("preds") + """
SELECT sample_id, text, label, generated, language, sem_type FROM preds""")
def q_d10(spark, sf):
    s = S.samples(spark, sf).select("sample_id", "text", "label", "language", "sem_type")
    p = S.predictions(spark, sf).select("sample_id", "generated")
    return D.pair_predictions(s, p).select("sample_id", "text", "label", "generated", "language", "sem_type")


@register("d10_unmatched_predictions", with_ctes("preds") + """
SELECT sample_id, generated FROM preds p
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.sample_id)""")
def q_d10b(spark, sf):
    labelled = S.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    p = S.predictions(spark, sf).select("sample_id", "generated")
    return D.unmatched_predictions(labelled, p)


@register("d11_union_splits", with_ctes("samples") + """
SELECT 'documents' AS split, sample_id, text, sem_type FROM samples
UNION ALL
SELECT 'conversations', conv_id * 1000 + turn, text, role FROM conversations""")
def q_d11(spark, sf):
    conv = S.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "text",
        F.col("role").alias("sem_type"))
    docs = S.samples(spark, sf).select("sample_id", "text", "sem_type")
    return D.union_splits({"documents": docs, "conversations": conv}).select(
        "split", "sample_id", "text", "sem_type")


# ---------------------------------------------------------------- E: aggregations

@register("e1_exact_match", with_ctes("preds") + """
SELECT avg(CASE WHEN generated = label THEN 1.0 ELSE 0.0 END) AS exact_match, count(*) AS n FROM preds""")
def q_e1(spark, sf):
    return E.exact_match(S.predictions(spark, sf))


@register("e2_accuracy_by_code", with_ctes("scored") + """
SELECT code, CAST(sum(correct) AS BIGINT) AS n_correct, count(*) AS n,
       sum(correct) / count(*) AS accuracy
FROM scored GROUP BY code""")
def q_e2(spark, sf):
    return E.accuracy_by_code(S.scored(spark, sf))


@register("e3_full_accuracy", with_ctes("scored") + """
SELECT code, avg(CAST(correct AS DOUBLE)) AS full, count(*) AS n,
       CASE WHEN GROUPING(code) = 1 THEN 'average' ELSE code END AS key, GROUPING(code) = 1 AS is_overall
FROM scored GROUP BY GROUPING SETS ((code), ())""")
def q_e3(spark, sf):
    return E.full_accuracy(S.scored(spark, sf))


@register("e4_partial_accuracy", with_ctes("scored") + "SELECT sample_id, partial FROM scored")
def q_e4(spark, sf):
    p = S.predictions(spark, sf)
    return p.select("sample_id", C.partial_accuracy("hyp_tokens", "ref_tokens").alias("partial"))


@register("e5_partial_accuracy_table", with_ctes("scored") + """
SELECT code, round(avg(partial), 6) AS partial, count(*) AS n,
       CASE WHEN GROUPING(code) = 1 THEN 'average' ELSE code END AS key, GROUPING(code) = 1 AS is_overall
FROM scored GROUP BY GROUPING SETS ((code), ())""")
def q_e5(spark, sf):
    return E.partial_accuracy_table(S.scored(spark, sf)).withColumn("partial", r6("partial"))


@register("e6_accuracy_breakdown", with_ctes("scored") + """
SELECT language, sem_type, avg(CAST(correct AS DOUBLE)) AS accuracy, count(*) AS n,
       CAST(GROUPING(language, sem_type) AS BIGINT) AS level
FROM scored GROUP BY CUBE (language, sem_type)""")
def q_e6(spark, sf):
    return E.accuracy_breakdown(S.scored(spark, sf)).withColumn("level", F.col("level").cast("long"))


@register("e7_top1_accuracy", with_ctes("scored") + """
SELECT CAST(sum(correct) AS BIGINT) AS n_correct, CAST(sum(1 - correct) AS BIGINT) AS n_wrong,
       count(*) AS n, sum(correct) / count(*) AS accuracy
FROM scored""")
def q_e7(spark, sf):
    return E.top1_accuracy(S.scored(spark, sf).withColumn("rank", F.lit(1)))


# The same questions where some answers are right.
@register("e2_accuracy_by_code_mixed", _mixed(ORACLE["e2_accuracy_by_code"]))
def q_e2b(spark, sf):
    return E.accuracy_by_code(S.mixed_scored(spark, sf))


@register("e3_full_accuracy_mixed", _mixed(ORACLE["e3_full_accuracy"]))
def q_e3b(spark, sf):
    return E.full_accuracy(S.mixed_scored(spark, sf))


@register("e6_accuracy_breakdown_mixed", _mixed(ORACLE["e6_accuracy_breakdown"]))
def q_e6b(spark, sf):
    return E.accuracy_breakdown(S.mixed_scored(spark, sf)).withColumn("level", F.col("level").cast("long"))


@register("evaluation_summary_mixed", _mixed(ORACLE["evaluation_summary"]))
def q_evaluation_summary_mixed(spark, sf):
    return evaluation_summary(S.mixed_scored(spark, sf))


@register("e8_outcome_counts", with_ctes("pairs") + r"""
, t AS (SELECT CASE WHEN coalesce(regexp_replace(regexp_replace(src, '^[\t\n\x0B\f\r ]+', ''), '[\t\n\x0B\f\r ]+\z', '') = '', true)
                      OR coalesce(regexp_replace(regexp_replace(tgt, '^[\t\n\x0B\f\r ]+', ''), '[\t\n\x0B\f\r ]+\z', '') = '', true)
                    THEN 'EMPTY' ELSE 'PASS' END AS outcome FROM pairs)
SELECT outcome, count(*) AS n FROM t GROUP BY outcome ORDER BY n DESC, outcome""")
def q_e8(spark, sf):
    pairs = B.tag_empty(S.conversation_pairs(spark, sf), ["src", "tgt"], keep_empty=True)
    return E.outcome_counts(pairs)


@register("e9_outcomes_per_code", with_ctes("scored") + """
SELECT code, pos, correct = 1 AS ok FROM scored""")
def q_e9(spark, sf):
    return E.outcomes_per_code(S.scored(spark, sf))


@register("e9_wrong_examples", with_ctes("scored") + """
SELECT code, pos, correct = 1 AS ok FROM scored WHERE correct = 0""")
def q_e9b(spark, sf):
    return E.wrong_examples(E.outcomes_per_code(S.scored(spark, sf)))


BITS_SQL = _mixed(with_ctes("scored") + """
, o AS (SELECT code, correct, row_number() OVER (PARTITION BY code ORDER BY pos) - 1 AS i FROM scored)
SELECT code, i // 256 AS chunk, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_right,
       string_agg(CAST(correct AS VARCHAR), '' ORDER BY i) AS outcomes
FROM o GROUP BY code, i // 256""")


@register("e9_outcome_lists", BITS_SQL)
def q_e9c(spark, sf):
    bits = E.outcome_bits(S.mixed_scored(spark, sf), chunk=256)
    return E.outcomes_of_bits(bits).withColumn("outcomes", F.array_join(F.col("outcomes").cast("array<string>"), ""))


@register("e9_accuracy_of_lists", _mixed(with_ctes("scored") + """
SELECT code, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct, sum(correct) / count(*) AS accuracy
FROM scored GROUP BY code"""))
def q_e9d(spark, sf):
    return E.accuracy_of_bits(E.outcome_bits(S.mixed_scored(spark, sf)))


@register("e10_token_totals", with_ctes("preds") + """
SELECT CAST(sum(len(hyp_tokens)) AS BIGINT) AS n_tokens, count(*) AS n_hypotheses FROM preds""")
def q_e10(spark, sf):
    return E.token_totals(S.predictions(spark, sf).withColumn("rank", F.lit(1)), rank="rank")


@register("e10_token_totals_of_best", with_ctes("hyps") + """
, best AS (SELECT length FROM hyps
           QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, beam, tie1, tie2) = 1)
SELECT CAST(sum(CAST(length AS BIGINT)) AS BIGINT) AS n_tokens, count(*) AS n_hypotheses FROM best""")
def q_e10b(spark, sf):
    # A hypothesis of ``length`` tokens; the rank is the real one.
    ranked = _ranked(spark, sf).withColumn("tokens", F.sequence(F.lit(1), F.col("length").cast("int")))
    return E.token_totals(ranked, "tokens", rank="rank")


@register("e11_report_lines", REPORT_SQL)
def q_e11(spark, sf):
    return _report(spark, sf)


@register("e11_code_accuracy_line", with_ctes("scored") + """
, t AS (SELECT code, sum(correct) / count(*) AS accuracy, min(pos) AS first_pos FROM scored GROUP BY code)
SELECT 'Code type Accuracy : ' || string_agg(coalesce(code, 'None') || ' : ' || CAST(accuracy AS VARCHAR), '  ;  ' ORDER BY first_pos) AS line
FROM t""")
def q_e11b(spark, sf):
    return E.code_accuracy_line(E.accuracy_by_code(S.scored(spark, sf), pos="pos"))


# Losses carry two decimals, so their sums rounded to 6 decimals are exact on
# both engines whatever the summation order; means are taken from those.
@register("e12_epoch_loss", with_ctes("tlog") + """
SELECT run, split, epoch, round(sum(loss), 6) / count(*) AS mean_loss, count(*) AS n_steps
FROM tlog GROUP BY run, split, epoch""")
def q_e12(spark, sf):
    out = E.epoch_loss(S.training_log(spark, sf))
    return out.select("run", "split", "epoch",
                      (r6("sum_loss") / F.col("n_steps")).alias("mean_loss"), "n_steps")


@register("e13_ensemble_logprob", with_ctes("cands") + """
, m AS (SELECT sample_id, step, max(lprob) AS m FROM cands GROUP BY sample_id, step)
SELECT c.sample_id, c.step, round(max(m.m) + ln(sum(exp(c.lprob - m.m))) - ln(count(*)), 6) AS ensemble_lprob,
       count(*) AS n_models
FROM cands c JOIN m USING (sample_id, step) GROUP BY c.sample_id, c.step""")
def q_e13(spark, sf):
    out = E.ensemble_logprob(S.candidates(spark, sf), ["sample_id", "step"])
    return out.withColumn("ensemble_lprob", r6("ensemble_lprob"))


@register("e13_ensemble_per_token", with_ctes("model_cands") + """
, m AS (SELECT sample_id, step, token_id, max(lprob) AS m FROM model_cands GROUP BY ALL)
SELECT c.sample_id, c.step, c.token_id,
       round(max(m.m) + ln(sum(exp(c.lprob - m.m))) - ln(count(*)), 6) AS ensemble_lprob, count(*) AS n_models
FROM model_cands c JOIN m USING (sample_id, step, token_id) GROUP BY c.sample_id, c.step, c.token_id""")
def q_e13b(spark, sf):
    out = E.ensemble_logprob(S.model_candidates(spark, sf), ["sample_id", "step", "token_id"])
    return out.withColumn("ensemble_lprob", r6("ensemble_lprob"))


@register("e14_mean_attention", with_ctes("attn") + """
, per_model AS (SELECT sample_id, model, tgt_pos, src_pos, avg(attn) AS attn FROM attn
                GROUP BY sample_id, model, tgt_pos, src_pos)
SELECT sample_id, tgt_pos, src_pos, round(avg(attn), 6) AS attn FROM per_model
GROUP BY sample_id, tgt_pos, src_pos""")
def q_e14(spark, sf):
    return E.mean_attention(S.attention(spark, sf)).withColumn("attn", r6("attn"))


@register("e15_argmax_token", with_ctes("cands") + """
SELECT sample_id, step, token_id AS best_token, lprob AS best_score FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, step ORDER BY lprob DESC, token_id) AS r FROM cands)
WHERE r = 1""")
def q_e15(spark, sf):
    return E.argmax_token(S.candidates(spark, sf), ["sample_id", "step"])


@register("e16_hard_alignment", with_ctes("attn") + """
, best AS (SELECT head, tgt_pos, src_pos FROM (
    SELECT *, row_number() OVER (PARTITION BY head, tgt_pos ORDER BY attn DESC, src_pos) AS r FROM attn
    WHERE src_pos <> 7) WHERE r = 1)
SELECT head, string_agg(CAST(src_pos AS VARCHAR) || '-' || CAST(tgt_pos AS VARCHAR), ' ' ORDER BY tgt_pos) AS alignment FROM best GROUP BY head""")
def q_e16(spark, sf):
    a = S.attention(spark, sf).withColumn("src_token", F.when(F.col("src_pos") == 7, F.lit(TK.EOS))
                                          .otherwise(F.lit(10)))
    aligned = E.hard_alignment(a, ["head"], src_token="src_token", skip_tokens=(TK.PAD, TK.EOS))
    return E.render_alignment(aligned, ["head"])


# ---------------------------------------------------------------- F: windows and ranking

@register("f1_running_loss", with_ctes("tlog") + """
SELECT split, epoch, step,
       round(sum(loss) OVER w, 6) / count(*) OVER w AS running_loss, count(*) OVER w AS running_count
FROM tlog
WINDOW w AS (PARTITION BY run, split, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_f1(spark, sf):
    out = R.running_loss(S.training_log(spark, sf))
    return out.select("split", "epoch", "step",
                      (r6("running_sum") / F.col("running_count")).alias("running_loss"),
                      "running_count")


F2_SQL = with_ctes("scored") + """
, per AS (
    SELECT CASE WHEN GROUPING(code) = 1 THEN 'average' ELSE code END AS key, GROUPING(code) AS g,
           pos // 64 AS batch_id, sum(correct) AS c, sum(partial) AS p, count(*) AS n
    FROM scored GROUP BY GROUPING SETS ((code, pos // 64), (pos // 64)))
SELECT key, g = 1 AS is_overall, batch_id,
       CAST(sum(n) OVER w AS BIGINT) AS n_so_far,
       sum(c) OVER w / sum(n) OVER w AS full_so_far,
       round(sum(p) OVER w / sum(n) OVER w, 6) AS partial_so_far
FROM per
WINDOW w AS (PARTITION BY g, key ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("f2_running_accuracy", F2_SQL)
def q_f2(spark, sf):
    sc = D.batches(S.scored(spark, sf), 64)
    out = R.running_accuracy(sc)
    return out.withColumn("partial_so_far", r6("partial_so_far"))


EPOCHS_SQL = """
, e AS (SELECT run, split, epoch, round(sum(loss), 6) / count(*) AS mean_loss FROM tlog
        GROUP BY run, split, epoch)"""


def _epochs(spark, sf) -> DataFrame:
    e = E.epoch_loss(S.training_log(spark, sf))
    return e.withColumn("mean_loss", r6("sum_loss") / F.col("n_steps"))


@register("f3_best_checkpoints", with_ctes("tlog") + EPOCHS_SQL + """
SELECT run, split, epoch, mean_loss,
       coalesce(mean_loss < min(mean_loss) OVER (PARTITION BY run, split ORDER BY epoch
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
FROM e""")
def q_f3(spark, sf):
    out = R.best_checkpoints(_epochs(spark, sf))
    return out.select("run", "split", "epoch", "mean_loss", "improved")


@register("f3_final_best", with_ctes("tlog") + EPOCHS_SQL + """
SELECT run, split, arg_min(epoch, (mean_loss, epoch)) AS best_epoch, min(mean_loss) AS best_loss
FROM e GROUP BY run, split""")
def q_f3b(spark, sf):
    return R.final_best(_epochs(spark, sf))


RANKED_SQL = """
, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, beam, tie1, tie2)
                            AS INTEGER) AS rank FROM hyps)"""


def _ranked(spark, sf, top: int | None = None) -> DataFrame:
    return R.rank_hypotheses(S.hypotheses(spark, sf), tie=("beam", "tie1", "tie2"), top=top)


@register("f4_n_best", with_ctes("hyps") + RANKED_SQL + """
SELECT sample_id, beam, tie1, tie2, score, rank FROM ranked WHERE rank <= 2""")
def q_f4(spark, sf):
    return _ranked(spark, sf, top=2).select("sample_id", "beam", "tie1", "tie2", "score", "rank")


@register("f4_n_best_of_full_ranking", with_ctes("hyps") + RANKED_SQL + """
SELECT sample_id, beam, tie1, tie2, score, rank FROM ranked WHERE rank <= 2""")
def q_f4b(spark, sf):
    return R.n_best(_ranked(spark, sf), 2).select("sample_id", "beam", "tie1", "tie2", "score", "rank")


@register("f5_length_normalized", with_ctes("hyps") + """
SELECT sample_id, beam, tie1, tie2, round(score / pow(length, 0.5), 6) AS norm_score FROM hyps""")
def q_f5(spark, sf):
    h = S.hypotheses(spark, sf)
    return h.select("sample_id", "beam", "tie1", "tie2",
                    r6(C.length_normalized("score", "length", 0.5)).alias("norm_score"))


@register("f6_rank_hypotheses", with_ctes("hyps") + RANKED_SQL + """
SELECT sample_id, beam, tie1, tie2, rank FROM ranked""")
def q_f6(spark, sf):
    return _ranked(spark, sf).select("sample_id", "beam", "tie1", "tie2", "rank")


@register("e7_top1_of_ranked", with_ctes("hyps") + RANKED_SQL + """
SELECT CAST(sum(correct) AS BIGINT) AS n_correct, CAST(sum(1 - correct) AS BIGINT) AS n_wrong,
       count(*) AS n, sum(correct) / count(*) AS accuracy
FROM (SELECT CASE WHEN tie1 % 3 = 0 THEN 1 ELSE 0 END AS correct FROM ranked WHERE rank = 1)""")
def q_e7_ranked(spark, sf):
    """Several hypotheses a sample, ranked by score; only the first counts."""
    right = F.when(F.col("tie1") % 3 == 0, 1).otherwise(0)
    return E.top1_accuracy(_ranked(spark, sf).withColumn("correct", right))


@register("f7_top_candidates", with_ctes("cands") + """
, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id, step ORDER BY lprob DESC, token_id, model)
                         AS INTEGER) AS cand_rank FROM cands QUALIFY cand_rank <= 4)
SELECT sample_id, step, token_id, model, lprob, cand_rank,
       is_end AND cand_rank <= 2 AS finished,
       NOT is_end AND row_number() OVER (PARTITION BY sample_id, step, is_end ORDER BY cand_rank) <= 2 AS active
FROM (SELECT *, token_id = 2 AND lprob <> '-inf'::DOUBLE AS is_end FROM top)""")
def q_f7(spark, sf):
    out = R.top_candidates(S.candidates(spark, sf), 2, ["sample_id", "step"], TK.EOS, tie=("model",))
    return out.select("sample_id", "step", "token_id", "model", "lprob", "cand_rank", "finished", "active")


@register("f8_finished_quota", with_ctes("hyps") + RANKED_SQL + """
, kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY beam, rank) AS INTEGER) AS finish_order
           FROM ranked QUALIFY finish_order <= 2)
SELECT sample_id, beam, tie1, tie2, finish_order,
       CAST(coalesce(max(CASE WHEN finish_order = 2 THEN beam END) OVER (PARTITION BY sample_id), 7) AS BIGINT) AS done_step
FROM kept""")
def q_f8(spark, sf):
    h = _ranked(spark, sf).withColumn("step", F.col("beam"))
    out = R.finished_quota(h, 2, 7)
    return out.select("sample_id", "beam", "tie1", "tie2", "finish_order", "done_step")


# (sample, beam, part, supplier) is not unique in every table: the score is
# the last tie-break, and rows equal in all of these are interchangeable.
@register("f9_position_scores", with_ctes("hyps") + """
, c AS (SELECT *, sum(score) OVER (PARTITION BY sample_id ORDER BY beam, tie1, tie2, score
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_score FROM hyps)
SELECT sample_id, beam, tie1, tie2,
       round(cum_score - coalesce(lag(cum_score) OVER (PARTITION BY sample_id ORDER BY beam, tie1, tie2, score), 0.0), 6) AS pos_score
FROM c""")
def q_f9(spark, sf):
    h = running(S.hypotheses(spark, sf), ["sample_id"], ["beam", "tie1", "tie2", "score"],
                {"cum_score": ("sum", "score")})
    out = R.position_scores(h, "sample_id", ["beam", "tie1", "tie2", "score"])
    return out.select("sample_id", "beam", "tie1", "tie2", r6("pos_score").alias("pos_score"))


@register("f9_position_scores_array", with_ctes("hyps") + """
, c AS (SELECT sample_id, list(score ORDER BY beam, tie1, tie2, score) AS s FROM hyps GROUP BY sample_id)
SELECT sample_id, list_transform(s, lambda x: round(x, 6)) AS pos_scores FROM c""")
def q_f9b(spark, sf):
    h = running(S.hypotheses(spark, sf), ["sample_id"], ["beam", "tie1", "tie2", "score"],
                {"cum_score": ("sum", "score")})
    arr = h.groupBy("sample_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("beam", "tie1", "tie2", "score", "cum_score"))),
        lambda s: s["cum_score"]).alias("cum"))
    return arr.select("sample_id", F.transform(R.position_scores_array("cum"), r6).alias("pos_scores"))


@register("f10_log_softmax", with_ctes("cands") + """
SELECT sample_id, step, token_id, model,
       round(lprob - max(lprob) OVER g - ln(sum(exp(lprob - max_l)) OVER g), 6) AS log_prob
FROM (SELECT *, max(lprob) OVER (PARTITION BY sample_id, step) AS max_l FROM cands)
WINDOW g AS (PARTITION BY sample_id, step)""")
def q_f10(spark, sf):
    out = R.log_softmax(S.candidates(spark, sf), ["sample_id", "step"])
    return out.select("sample_id", "step", "token_id", "model", r6("log_prob").alias("log_prob"))


@register("f11_constrain_scores", with_ctes("cands") + """
SELECT sample_id, step, token_id, model,
       CASE WHEN step < 2 AND token_id = 2 THEN '-inf'::DOUBLE
            WHEN step >= 6 AND token_id <> 2 THEN '-inf'::DOUBLE
            WHEN token_id = 3 THEN (CASE WHEN isnan(lprob) THEN '-inf'::DOUBLE ELSE lprob END) - 0.5
            WHEN token_id = 1 THEN '-inf'::DOUBLE
            WHEN isnan(lprob) THEN '-inf'::DOUBLE ELSE lprob END AS lprob
FROM cands""")
def q_f11(spark, sf):
    out = R.constrain_scores(S.candidates(spark, sf), pad=TK.PAD, unk=TK.UNK, eos=TK.EOS,
                             unk_penalty=0.5, min_len=2, max_len=6)
    return out.select("sample_id", "step", "token_id", "model", "lprob")


FORCED_SQL = with_ctes("broken") + """
, v AS (SELECT * REPLACE (CASE WHEN token_id = 1 OR isnan(lprob) THEN '-inf'::DOUBLE
                               WHEN token_id = 3 THEN lprob - 0.5 ELSE lprob END AS lprob) FROM broken),
c AS (SELECT * REPLACE (CASE WHEN step >= 6 AND token_id <> 2 THEN '-inf'::DOUBLE
                             WHEN coalesce(forced <> 1, false) THEN
                                 (CASE WHEN token_id <> forced THEN '-inf'::DOUBLE ELSE lprob END)
                             WHEN step < 5 AND token_id = 2 THEN '-inf'::DOUBLE ELSE lprob END AS lprob) FROM v)
"""


def _forced(spark, sf) -> DataFrame:
    return R.constrain_scores(S.broken_candidates(spark, sf), pad=TK.PAD, unk=TK.UNK, eos=TK.EOS,
                              unk_penalty=0.5, min_len=5, max_len=6, prefix="forced")


@register("f11_constrain_with_prefix", FORCED_SQL + "SELECT sample_id, step, token_id, part, model, lprob FROM c")
def q_f11b(spark, sf):
    return _forced(spark, sf).select("sample_id", "step", "token_id", "part", "model", "lprob")


# A sample's candidates of all steps, so that ends, ruled-out ends and other tokens compete.
@register("f7_top_of_constrained", FORCED_SQL + """
, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY lprob DESC, token_id, step, part, model)
                         AS INTEGER) AS cand_rank FROM c QUALIFY cand_rank <= 4)
SELECT sample_id, step, token_id, part, model, lprob, cand_rank,
       is_end AND cand_rank <= 2 AS finished,
       NOT is_end AND row_number() OVER (PARTITION BY sample_id, is_end ORDER BY cand_rank) <= 2 AS active
FROM (SELECT *, token_id = 2 AND lprob <> '-inf'::DOUBLE AS is_end FROM top)""")
def q_f7b(spark, sf):
    out = R.top_candidates(_forced(spark, sf), 2, ["sample_id"], TK.EOS, tie=("step", "part", "model"))
    return out.select("sample_id", "step", "token_id", "part", "model", "lprob", "cand_rank", "finished", "active")


@register("f12_force_prefix", with_ctes("cands") + """
, p AS (SELECT sample_id, step, min(token_id) AS prefix_token FROM cands WHERE step <= 2 GROUP BY sample_id, step)
SELECT c.sample_id, c.step, c.token_id, c.model,
       CASE WHEN p.prefix_token IS NOT NULL AND p.prefix_token <> 1 AND c.token_id <> p.prefix_token
            THEN '-inf'::DOUBLE ELSE c.lprob END AS lprob
FROM cands c LEFT JOIN p USING (sample_id, step)""")
def q_f12(spark, sf):
    cands = S.candidates(spark, sf)
    prefix = cands.filter(F.col("step") <= 2).groupBy("sample_id", "step").agg(
        F.min("token_id").alias("prefix_token"))
    out = R.force_prefix(cands, prefix, ["sample_id", "step"], TK.PAD)
    return out.select("sample_id", "step", "token_id", "model", "lprob")


@register("f13_reject_overlong", with_ctes("hyps") + """
SELECT sample_id, beam, tie1, tie2,
       CASE WHEN beam > floor(length / 8) THEN '-inf'::DOUBLE ELSE score END AS score
FROM hyps""")
def q_f13(spark, sf):
    h = S.hypotheses(spark, sf).withColumn("step", F.col("beam")).withColumn(
        "src_len", F.floor(F.col("length") / 8))
    return R.reject_overlong(h).select("sample_id", "beam", "tie1", "tie2", "score")


# ---------------------------------------------------------------- I: streaming

@register("i1_stream_accuracy", """
SELECT event_type AS code, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*) AS accuracy
FROM events GROUP BY event_type""")
def q_i1(spark, sf):
    from lexmetric.streaming.accuracy import stream_accuracy
    schema = S.table(spark, sf, "events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf))
    results = stream.select(F.col("event_type").alias("code"), (F.col("value") > 50).alias("ok"))
    return stream_accuracy(spark, results).select("code", "n_correct", "n", "accuracy")


ARRIVALS = 3


@register("i1_stream_history", _mixed(with_ctes("scored") + f"""
SELECT CAST(b.batch_id AS INTEGER) AS batch_id, CASE WHEN GROUPING(code) = 1 THEN 'average' ELSE code END AS key,
       GROUPING(code) = 1 AS is_overall, count(*) AS n, CAST(sum(correct) AS BIGINT) AS n_correct,
       sum(correct) / count(*) AS full, round(avg(partial), 6) AS partial
FROM range({ARRIVALS}) b(batch_id) JOIN scored ON pos % {ARRIVALS} <= b.batch_id
GROUP BY GROUPING SETS ((b.batch_id, code), (b.batch_id))"""))
def q_i1b(spark, sf):
    """Results arrive in three loads; after each the stream is started anew,
    adds what has come, and writes its report as the next batch."""
    from lexmetric.streaming.accuracy import stream_accuracy
    results = S.mixed_scored(spark, sf).select("pos", "code", F.col("correct").alias("ok"), "partial")
    base = shared_dir(spark, "i1")
    for k in range(ARRIVALS):
        results.filter(F.col("pos") % ARRIVALS == k).write.mode("append").parquet(f"{base}/arrived")
        stream = spark.readStream.schema(results.schema).parquet(f"{base}/arrived")
        _, history = stream_accuracy(spark, stream, out_dir=base, history=True, partial="partial")
    return history.select("batch_id", "key", "is_overall", "n", "n_correct", "full", r6("partial").alias("partial"))


# ---------------------------------------------------------------- J: user functions

def _reverse_words_predictor():
    import re
    split = re.compile(r"[\t\n\x0b\f\r ]+")

    def fn(texts: list[str]) -> list[str]:
        return [" ".join(reversed([w for w in split.split(t) if w])) if t is not None else None
                for t in texts]
    return fn


@register("j1_predict", with_ctes("samples") + """
SELECT sample_id, text, label, array_to_string(list_reverse(tokens), ' ') AS generated FROM samples""")
def q_j1(spark, sf):
    from lexmetric.operators.predict import predict
    return predict(S.samples(spark, sf), _reverse_words_predictor, batch_size=64)


def _some_reversed_predictor():
    """The words of a text, reversed where their number divides by 3."""
    reverse = _reverse_words_predictor()

    def fn(texts: list[str]) -> list[str]:
        turned = reverse(texts)
        return [t if t is None or (t.count(" ") + bool(t)) % 3 == 0 else u
                for t, u in zip(turned, reverse(turned), strict=True)]
    return fn


@register("score_predictions", with_ctes("samples") + """
SELECT language, sem_type, avg(CAST(correct AS DOUBLE)) AS accuracy, count(*) AS n,
       CAST(GROUPING(language, sem_type) AS BIGINT) AS level
FROM (SELECT language, sem_type,
             CASE WHEN array_to_string(CASE WHEN len(tokens) % 3 = 0 THEN list_reverse(tokens) ELSE tokens END, ' ')
                       = label THEN 1 ELSE 0 END AS correct
      FROM samples) GROUP BY CUBE (language, sem_type)""")
def q_score_predictions(spark, sf):
    from lexmetric.plans.evaluation import score_predictions
    s = S.samples(spark, sf).select("sample_id", "text", "label", "language", "sem_type")
    return score_predictions(s, _some_reversed_predictor)["breakdown"].withColumn("level", F.col("level").cast("long"))


def _strip_accents(s: str) -> str:
    return s.translate(str.maketrans(ACCENTED, PLAIN))


@register("j2_map_text", with_ctes("samples") + f"""
SELECT sample_id, language,
       CASE WHEN language = 'fr' THEN translate(text, '{ACCENTED}', '{PLAIN}') ELSE text END AS text
FROM samples""")
def q_j2(spark, sf):
    from lexmetric.operators.predict import map_text
    s = S.samples(spark, sf)
    is_fr = F.col("language").eqNullSafe("fr")
    fr = map_text(s.filter(is_fr), _strip_accents)
    return fr.unionByName(s.filter(~is_fr)).select("sample_id", "language", "text")


# ---------------------------------------------------------------- plans (end to end)

@register("prepare_corpus", with_ctes("localized") + """
SELECT sample_id, pos, language, text, label, sem_type FROM localized
WHERE language = list_element(['fr', 'es', 'ar', 'de', 'en', 'ja'], CAST(((pos + 1) // 6) % 6 AS INTEGER) + 1)""")
def q_prepare_corpus(spark, sf):
    from lexmetric.plans.corpus import prepare_corpus
    trimmed, _pending = prepare_corpus(S.samples(spark, sf).drop("tokens"),
                                       S.translation_memory(spark, sf))
    return trimmed.select("sample_id", "pos", "language", "text", "label", "sem_type")


@register("prepare_corpus_pending", ORACLE["d3_pending_translations"])
def q_prepare_pending(spark, sf):
    from lexmetric.plans.corpus import prepare_corpus
    _trimmed, pending = prepare_corpus(S.samples(spark, sf).drop("tokens"), S.translation_memory(spark, sf))
    return pending


EVAL_PLAN_SQL = with_ctes("encoded", "codes") + """
, txt AS (
    SELECT x.sample_id,
           string_agg(x.token, ' ' ORDER BY x.p) FILTER (WHERE (x.p - 1 + x.sample_id) % 7 <> 0) AS hyp_text,
           string_agg(x.token, ' ' ORDER BY x.p) AS ref_text
    FROM exploded x JOIN vocab v ON x.token = v.token AND NOT v.is_special
    GROUP BY x.sample_id),
h AS (
    SELECT e.sample_id, e.pos, e.ids,
           list_filter(e.ids, lambda x, i: (i - 1 + e.sample_id) % 7 <> 0) AS hyp_ids,
           coalesce(t.hyp_text, '') AS hyp_text, coalesce(t.ref_text, '') AS ref_text
    FROM encoded e LEFT JOIN txt t USING (sample_id)),
best AS (
    SELECT *, (-1.0 / (len(hyp_ids) + 1)) >= (-2.0 / (len(ids) + 1)) AS pick_hyp FROM h),
scored AS (
    SELECT b.pos, c.code,
           CASE WHEN (CASE WHEN pick_hyp THEN hyp_text ELSE ref_text END) = ref_text THEN 1 ELSE 0 END AS correct,
           CASE WHEN len(ids) > 0 THEN
               greatest(len(list_filter(range(1, len(ids) + 1),
                        lambda i: ids[i] = (CASE WHEN pick_hyp THEN hyp_ids ELSE ids END)[i]))
                        - greatest(len(ids) - len(CASE WHEN pick_hyp THEN hyp_ids ELSE ids END), 0), 0)::DOUBLE
               / len(ids) END AS partial
    FROM best b LEFT JOIN codes c USING (pos))
""" + REPORT_SQL[REPORT_SQL.index(", t AS ("):]


@register("evaluate_hypotheses", EVAL_PLAN_SQL)
def q_evaluate_hypotheses(spark, sf):
    from lexmetric.plans.evaluation import evaluate_hypotheses
    from lexmetric.session import materialize
    vocab = _vocab(spark, sf)
    enc = materialize(_encoded(spark, sf, vocab))   # feeds three branches
    hyp = enc.select("sample_id", F.lit(0).alias("beam"),
                     S.hypothesis_tokens(F.col("ids"), F.col("sample_id")).alias("tokens"),
                     F.lit(-1.0).alias("score"))
    ref = enc.select("sample_id", F.lit(1).alias("beam"), F.col("ids").alias("tokens"),
                     F.lit(-2.0).alias("score"))
    targets = enc.select("sample_id", "pos", F.col("ids").alias("target_tokens"))
    out = evaluate_hypotheses(hyp.unionByName(ref), targets, vocab, S.codes(spark, sf))
    return out["report"]



def _vector_sum_model():
    import numpy as np

    def fn(batch):
        return np.asarray(batch, dtype="float64").reshape(len(batch), -1).sum(axis=1)
    return fn


@register("j1_predict_numeric", with_ctes("vecs") + """
SELECT vec_id, round(list_sum(vec), 6) AS prediction FROM vecs""")
def q_j1_numeric(spark, sf):
    from lexmetric.operators.predict import predict_numeric
    v = S.vectors(spark, sf)
    out = predict_numeric(v, _vector_sum_model, "vec", batch_size=64, input_shape=[64])
    return out.select("vec_id", r6("prediction").alias("prediction"))
