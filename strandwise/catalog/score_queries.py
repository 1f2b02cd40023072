"""Scored reads: softmax, calls, quality, composition, confidence, losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.operators import confidence as C, metrics as M
from strandwise.operators.scoring import score_reads
from strandwise.plans.reports import sample_composition
from strandwise.session import scratch_path
from strandwise.streaming.ingest import running_composition

P = V.PROBS_SQL
R = V.KEYED_SQL


@query("softmax", f"SELECT read_id, round(probs[1], 6) AS p0, round(probs[10], 6) AS p9, pred, round(max_prob, 6) AS max_prob FROM ({P}) p")
def softmax(spark, sf):
    return V.scored(spark, sf).select(
        "read_id", F.round(F.get("probs", F.lit(0)), 6).alias("p0"), F.round(F.get("probs", F.lit(9)), 6).alias("p9"),
        F.col("pred"), F.round(F.array_max("probs"), 6).alias("max_prob"),
    )


def _linear_model():
    """A fixed linear scorer standing for the user's model: class j scores the j-th entry and the one after it."""

    def predict(pdf):
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        return x[:, :-1] - 0.5 * x[:, 1:]

    return predict


@query("score_reads", """
SELECT read_id, list_position(s, list_max(s)) - 1 AS pred, round(list_max(s), 6) AS top_logit FROM (
 SELECT vec_id AS read_id, list_transform(range(1, len(embedding)), lambda j: CAST(embedding[j] AS DOUBLE) - 0.5 * CAST(embedding[j + 1] AS DOUBLE)) AS s FROM embeddings) t""")
def score_reads_query(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("read_id"), "embedding")
    return score_reads(rows, _linear_model, ["embedding"]).select(
        "read_id", "pred", F.round(F.array_max("logits"), 6).alias("top_logit")
    )


@query("confusion_matrix", f"SELECT true_label, pred, count(*) AS n FROM ({P}) p GROUP BY ALL")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(V.scored(spark, sf))


REPORT_SQL = f"""
WITH p AS ({P}), l AS (SELECT true_label AS label FROM p UNION SELECT pred FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE true_label = label) AS support, (SELECT count(*) FROM p WHERE pred = label) AS predicted,
  (SELECT count(*) FROM p WHERE pred = label AND true_label = label) AS correct FROM l),
m AS (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN correct / support ELSE 0.0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * correct / (support + predicted) ELSE 0.0 END AS f1 FROM c)
"""


@query("class_report", REPORT_SQL + "SELECT label, support, predicted, correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def class_report(spark, sf):
    r = M.class_report(V.scored(spark, sf))
    return r.select("label", "support", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("classification_metrics", REPORT_SQL + """SELECT CAST(sum(support) AS BIGINT) AS n_reads, round(sum(correct) / sum(support), 6) AS accuracy,
 round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM m""")
def classification_metrics(spark, sf):
    return M.classification_metrics(V.scored(spark, sf))


def _composition_sql(by: str, extra: str = "") -> str:
    return f"""SELECT {extra}{by}, pred, n_reads, round(100.0 * n_reads / sum(n_reads) OVER (PARTITION BY {by}), 2) AS pct,
 round(a, 3) AS avg_confidence, round(s, 3) AS std_confidence, round(lo, 3) AS min_confidence, round(hi, 3) AS max_confidence,
 row_number() OVER (PARTITION BY {by} ORDER BY n_reads DESC, pred) = 1 AS is_dominant
FROM (SELECT {by}, pred, count(*) AS n_reads, avg(max_prob) AS a, stddev_pop(max_prob) AS s, min(max_prob) AS lo, max(max_prob) AS hi FROM ({P}) p GROUP BY ALL) g"""


@query("composition", _composition_sql("sample_id"))
def composition(spark, sf):
    return M.composition(V.scored(spark, sf))


@query("composition_by_region_type", _composition_sql("dmr_ctype", "'Region_' || CAST(dense_rank() OVER (ORDER BY dmr_ctype) - 1 AS VARCHAR) AS region, "))
def composition_by_region_type(spark, sf):
    return M.composition_by_region_type(V.scored(spark, sf))


@query("composition_verdict", f"""
SELECT s.sample_id, n_reads, dominant, round(100.0 * best / n_reads, 2) AS dominant_pct, avg_confidence, std_confidence FROM
 (SELECT sample_id, count(*) AS n_reads, round(avg(max_prob), 3) AS avg_confidence, round(stddev_pop(max_prob), 3) AS std_confidence FROM ({P}) p GROUP BY sample_id) s
 JOIN (SELECT sample_id, pred AS dominant, n AS best FROM (SELECT sample_id, pred, count(*) AS n, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, pred) AS k
  FROM ({P}) p GROUP BY sample_id, pred) c WHERE k = 1) d ON s.sample_id = d.sample_id""")
def composition_verdict(spark, sf):
    return M.composition_verdict(V.scored(spark, sf))


@query("sample_composition", f"""
SELECT sample_id, dmr_ctype, pred, count(*) AS n_reads, round(avg(max_prob), 3) AS avg_confidence FROM ({P}) p
GROUP BY GROUPING SETS ((sample_id, dmr_ctype, pred), (sample_id, pred))""")
def sample_composition_query(spark, sf):
    return sample_composition(V.scored(spark, sf))


@query("running_composition", f"SELECT sample_id, pred, count(*) AS n_reads FROM ({P}) p GROUP BY ALL")
def running_composition_query(spark, sf):
    """The scored table read as a stream to its end; the last state of the counts is the result."""
    src, out, state = (scratch_path(spark, n) for n in ("scored", "counts", "state"))
    V.scored(spark, sf).select("sample_id", "pred").write.parquet(src)
    stream = spark.readStream.schema("sample_id string, pred int").option("maxFilesPerTrigger", 4).parquet(src)
    q = (
        running_composition(stream).writeStream.outputMode("complete")
        .foreachBatch(lambda counts, i: counts.write.mode("overwrite").parquet(f"{out}/{i:06d}"))
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{out}/{q.lastProgress['batchId']:06d}")


@query("pooled_call", f"""
SELECT sample_id, class, round(m, 6) AS mean_prob, row_number() OVER (PARTITION BY sample_id ORDER BY m DESC, class) AS place, n_called, n_reads FROM (
 SELECT sample_id, i - 1 AS class, avg(probs[i]) AS m, count(*) FILTER (pred = i - 1) AS n_called, count(*) AS n_reads
 FROM (SELECT sample_id, probs, pred, unnest(range(1, len(probs) + 1)) AS i FROM ({P}) p) q GROUP BY sample_id, i) g""")
def pooled_call(spark, sf):
    return M.pooled_call(V.scored(spark, sf))


@query("class_weights", f"""
SELECT ctype, n_rows, round((1.0 / (n_rows + 1e-8)) / avg(1.0 / (n_rows + 1e-8)) OVER (), 6) AS weight,
 round(greatest(least(1.0 - n_rows / sum(n_rows) OVER (), CAST(0.9 AS DOUBLE)), CAST(0.6 AS DOUBLE)), 6) AS alpha_pos, CAST(1.0 AS DOUBLE) AS alpha_neg
FROM (SELECT ctype, count(*) AS n_rows FROM ({R}) r GROUP BY ctype) g""")
def class_weights(spark, sf):
    return M.class_weights(V.reads(spark, sf))


@query("class_priors", f"""
SELECT ctype, n_rows, round(p, 6) AS prior, round(ln(p / (1.0 - p)), 6) AS bias FROM (
 SELECT ctype, n_rows, n_rows / sum(n_rows) OVER () AS p FROM (SELECT ctype, count(*) AS n_rows FROM ({R}) r GROUP BY ctype) g) h""")
def class_priors(spark, sf):
    return M.class_priors(V.reads(spark, sf), "logit")


@query("per_class_confidence", f"""
SELECT true_label, count(*) AS n_reads, round(avg(CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
 round(avg(probs[true_label + 1]), 6) AS confidence FROM ({P}) p GROUP BY true_label""")
def per_class_confidence(spark, sf):
    return M.per_class_confidence(V.scored(spark, sf))


CW = [0.5 + 0.1 * (i % 10) for i in range(64)]


@query("loss_metrics", f"""
WITH p AS (SELECT *, -ln(probs[true_label + 1]) AS ce, ({CW!r})[true_label + 1] AS w FROM ({P}) p)
SELECT count(*) AS n_reads, round(avg(ce * w), 6) AS cross_entropy, round(avg(power(1 - probs[true_label + 1], 2) * ce * w), 6) AS focal,
 round(avg(list_sum(list_transform(range(1, len(logits) + 1), lambda i: CASE WHEN i = true_label + 1
  THEN 0.75 * greatest(1 - 1 / (1 + exp(-logits[i])), 1e-6) * ln(1 + exp(-logits[i])) ELSE 0.5 * greatest(1 / (1 + exp(-logits[i])), 1e-6) * ln(1 + exp(logits[i])) END))), 6) AS focal_one_vs_rest
FROM p""")
def loss_metrics(spark, sf):
    return M.loss_metrics(V.logits(spark, sf), weights=CW, alpha_pos=[0.75] * 64, alpha_neg=[0.5] * 64)


EXTREMES_SQL = f"""
WITH p AS (SELECT *, array_to_string(list_transform(probs, lambda x: round(x, 3)), '|') AS v FROM ({P}) p),
u AS (SELECT kind, p.*, row_number() OVER (PARTITION BY kind, true_label, v ORDER BY sgn * max_prob, read_id) AS d, sgn FROM p, (VALUES ('low', 1.0), ('high', -1.0)) k(kind, sgn)),
q AS (SELECT *, row_number() OVER (PARTITION BY kind, true_label ORDER BY sgn * max_prob, read_id) AS place FROM u WHERE d = 1)
"""


@query("confidence_extremes", EXTREMES_SQL + """,
b AS (SELECT *, list_transform(list_sort(list_transform(range(0, len(probs)), lambda i: [-probs[i + 1], i]))[1:4], lambda s: CAST(s[2] AS INT)) AS best FROM q WHERE place <= 15)
SELECT kind, true_label, place, read_id, pred, round(max_prob, 6) AS confidence,
 array_to_string(CASE WHEN list_contains(best, true_label) THEN best ELSE list_append(best, true_label) END, ' ') AS classes FROM b""")
def confidence_extremes(spark, sf):
    return C.confidence_extremes(V.scored(spark, sf)).drop("class_probs").withColumn("confidence", F.round("confidence", 6))


@query("confidence_summary", EXTREMES_SQL + """SELECT kind, true_label, count(*) AS n_examples, round(avg(max_prob), 6) AS avg_confidence,
 round(min(max_prob), 6) AS min_confidence, round(max(max_prob), 6) AS max_confidence FROM q WHERE place <= 15 GROUP BY ALL""")
def confidence_summary(spark, sf):
    return C.confidence_summary(C.confidence_extremes(V.scored(spark, sf)))


@query("top_classes", f"""
SELECT read_id, i AS place, CAST(s[i][2] AS INT) AS class, round(-s[i][1], 6) AS prob FROM (
 SELECT read_id, s, unnest(range(1, 6)) AS i FROM (SELECT read_id, list_sort(list_transform(range(0, len(probs)), lambda i: [-probs[i + 1], i])) AS s FROM ({P}) p) t) u""")
def top_classes(spark, sf):
    return C.top_classes(V.scored(spark, sf)).withColumn("prob", F.round("prob", 6))
