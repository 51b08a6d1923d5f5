"""Quality metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.arrays import topk_indices, topn_hit
from framewise.functions.text import clean_subwords, normalize_answer, words
from framewise.operators.scale import join_on, running
from framewise.session import cut_lineage


def precision_recall(
    matches: DataFrame, truths: DataFrame, by: str = "label", score: str = "score",
    ids: Sequence[str] = ("frame", "det_id"),
) -> DataFrame:
    """Running precision and recall per class by falling score.

    ``matches`` has tp and fp, ``truths`` the ground truth with ``difficult``.
    """
    # written once, as bounds, sums of buckets and rows all read them
    matches = cut_lineage(matches)
    total = truths.groupBy(by).agg(F.count_if(~F.col("difficult")).alias("_truths"))
    rows = running(
        matches, [by], [f"-{score}", *ids],
        {"cum_tp": ("sum", F.col("tp")), "cum_fp": ("sum", F.col("fp"))},
    )
    out = join_on(rows, total, [by])
    tp, fp = F.col("cum_tp").cast("double"), F.col("cum_fp").cast("double")
    return (
        out.withColumn("recall", F.try_divide(tp, F.col("_truths").cast("double")))
        .withColumn("precision", tp / F.greatest(tp + fp, F.lit(2.220446049250313e-16)))
        .drop("_truths")
    )


def average_precision(curve: DataFrame, by: str = "label") -> DataFrame:
    """11-point interpolated average precision per class, and the mean (NULL class)."""
    best = curve.groupBy(by).agg(
        *(F.max(F.when(F.col("recall") >= F.lit(i) * 0.1, F.col("precision"))).alias(f"_p{i}") for i in range(11))
    )
    total = sum((F.coalesce(f"_p{i}", F.lit(0.0)) for i in range(11)), F.lit(0.0))
    per = cut_lineage(best.select(by, (total / 11.0).alias("ap")))
    mean = per.agg(F.avg("ap").alias("ap")).select(
        F.lit(None).cast(per.schema[by].dataType).alias(by), "ap"
    )
    return per.unionByName(mean)


def topn_accuracy(df: DataFrame, scores: str, label: str, n: int) -> DataFrame:
    return df.agg(
        F.avg(topn_hit(F.col(scores), F.col(label), n).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def _ngrams(tokens: Column, order: int) -> Column:
    """All n-grams up to ``order`` as structs (n, gram)."""
    def of(n: int) -> Column:
        # a sequence may also count down, so short texts get an empty list instead
        starts = F.when(
            F.size(tokens) >= n, F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.struct(
                F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n), " ").alias("gram")
            ),
        )

    return F.concat(*(of(n) for n in range(1, order + 1)))


def bleu(df: DataFrame, pair: Sequence[str], ref: str, hyp: str, order: int = 4) -> DataFrame:
    """Corpus BLEU: one row with the score, both lengths, matches and totals per order."""
    base = df.select(
        *pair, clean_subwords(F.col(ref)).alias("_r"), clean_subwords(F.col(hyp)).alias("_h")
    )

    def counts(tokens: str, name: str) -> DataFrame:
        grams = base.select(*pair, F.explode(_ngrams(F.col(tokens), order)).alias("_g"))
        return grams.groupBy(*pair, "_g.n", "_g.gram").agg(F.count(F.lit(1)).alias(name))

    both = counts("_h", "_ch").join(counts("_r", "_cr"), [*pair, "n", "gram"])
    matches = both.groupBy("n").agg(F.sum(F.least("_ch", "_cr")).alias("matches"))
    sizes = base.agg(
        F.sum(F.size("_r")).alias("ref_len"), F.sum(F.size("_h")).alias("hyp_len"),
        F.array(
            *(
                F.sum(F.greatest(F.size("_h") - (n - 1), F.lit(0))).alias(f"t{n}")
                for n in range(1, order + 1)
            )
        ).alias("_possible"),
    )
    # at most `order` rows of sums
    by_order = matches.agg(F.map_from_entries(F.collect_list(F.struct("n", "matches"))).alias("_m"))
    row = sizes.join(F.broadcast(by_order))
    precision = [
        F.try_divide(
            F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(0)).cast("double"),
            F.get("_possible", F.lit(n - 1)).cast("double"),
        )
        for n in range(1, order + 1)
    ]
    ok = F.lit(True)
    for p in precision:
        ok = ok & F.coalesce(p > 0, F.lit(False))
    log_sum = F.lit(0.0)
    for p in precision:
        log_sum = log_sum + F.log(p) / order
    geo = F.when(ok, F.exp(log_sum)).otherwise(F.lit(0.0))
    ratio = F.col("hyp_len") / F.col("ref_len")
    penalty = F.when(ratio > 1.0, F.lit(1.0)).otherwise(
        F.exp(1.0 - F.try_divide(F.lit(1.0), ratio))
    )
    return row.select((geo * F.coalesce(penalty, F.lit(0.0)) * 100.0).alias("bleu"), "ref_len", "hyp_len")


def qa_scores(pred: DataFrame, truth: DataFrame, on: str, truth_id: str) -> DataFrame:
    """Exact match and token F1 in percent: best truth per question, unanswered counts 0.

    ``pred`` has (on, text), ``truth`` one row (on, truth_id, text) per accepted answer.
    """
    p = pred.select(on, normalize_answer(F.col("text")).alias("_p"))
    pairs = truth.select(on, truth_id, normalize_answer(F.col("text")).alias("_t")).join(
        p, on, "left"
    )
    pairs = pairs.withColumn("_exact", F.coalesce(F.col("_p") == F.col("_t"), F.lit(False)).cast("double"))

    def bag(text: str, name: str) -> DataFrame:
        rows = pairs.select(on, truth_id, F.explode(words(F.col(text))).alias("w"))
        return rows.groupBy(on, truth_id, "w").agg(F.count(F.lit(1)).alias(name))

    same = (
        bag("_p", "_np")
        .join(bag("_t", "_nt"), [on, truth_id, "w"])
        .groupBy(on, truth_id)
        .agg(F.sum(F.least("_np", "_nt")).alias("_same"))
    )
    scored = join_on(pairs, same, [on, truth_id])
    s = F.col("_same").cast("double")
    precision = s / F.size(words(F.col("_p")))
    recall = s / F.size(words(F.col("_t")))
    f1 = F.when(F.col("_same") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    best = scored.withColumn("_f1", f1).groupBy(on).agg(
        F.max("_exact").alias("_e"), F.max("_f1").alias("_f")
    )
    return best.agg(
        (F.avg("_e") * 100.0).alias("exact_match"), (F.avg("_f") * 100.0).alias("f1"),
        F.count(F.lit(1)).alias("n"),
    )


def n_best(
    df: DataFrame, keys: Sequence[str], n: int, max_len: int, start: str = "start_logits",
    end: str = "end_logits", tokens: str = "tokens", usable: str = "usable",
) -> DataFrame:
    """Best answer spans per row: ``rank``, ``text``, ``start``, ``end``, ``score``, ``prob``.

    The n best starts meet the n best ends of their row; a span starts in its max
    context window (``usable`` holds per position), does not run backwards and has at
    most ``max_len`` tokens. Of equal texts the best stays. At most n * n spans per row.
    """
    rows = df.select(
        *keys, tokens, usable, start, end,
        F.explode(topk_indices(F.col(start), n)).alias("start"),
        topk_indices(F.col(end), n).alias("_ends"),
    )
    rows = rows.withColumn("end", F.explode("_ends"))
    s, e = F.col("start"), F.col("end")
    fits = (e >= s) & (e - s + 1 <= max_len) & F.get(usable, s) & (e < F.size(tokens))
    rows = rows.filter(fits)
    text = F.array_join(F.slice(tokens, s + 1, e - s + 1), " ")
    text = F.replace(F.replace(text, F.lit(" ##"), F.lit("")), F.lit("##"), F.lit(""))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = rows.select(
        *keys, s.cast("long").alias("start"), e.cast("long").alias("end"), text.alias("text"),
        (F.get(start, s) + F.get(end, e)).alias("score"),
    )
    by_score = [F.desc("score"), F.col("start"), F.col("end")]
    same = Window.partitionBy(*keys, "text").orderBy(*by_score)
    rows = rows.filter(F.col("text") != "")
    rows = rows.withColumn("_first", F.row_number().over(same)).filter("_first = 1").drop("_first")
    order = Window.partitionBy(*keys).orderBy(*by_score)
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    whole = Window.partitionBy(*keys)
    weight = F.exp(F.col("score") - F.max("score").over(whole))
    rows = rows.withColumn("_w", weight)
    return rows.withColumn("prob", F.col("_w") / F.sum("_w").over(whole)).drop("_w")

