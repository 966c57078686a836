"""Scores to summaries: run metrics, retired labels, abstention, cost, percentiles, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit import labels as L
from assaykit.functions.answers import recites_retired, retired_citations, score_fields, with_answer
from assaykit.operators.ordering import placed
from assaykit.shared import fresh


def score_responses(responses: DataFrame) -> DataFrame:
    """responses (…, text, gold, gold_heading, errored) with columns parsed and score.

    Each line of an answer is searched once, and its citations are found once, as columns of their
    own that the structs refer to. A null text is unparseable.
    """
    own, cited = fresh(responses, "_answer_"), fresh(responses, "_cited")
    df = with_answer(responses, "text", own).withColumn(cited, retired_citations(F.coalesce("text", F.lit(""))))
    names = ("label", "heading", "answerable", "why", "unparseable")
    parsed = F.struct(*(F.col(f"{own}{n}").alias(n) for n in names))
    fields = score_fields(F.col("gold"), F.col("gold_heading"), *(F.col(f"{own}{n}") for n in ("label", "heading", "unparseable")), F.col("errored"), F.col(cited))
    df = df.withColumns({"parsed": parsed, "score": F.struct(*(c.alias(n) for n, c in fields.items()))})
    return df.drop(cited, *(f"{own}{n}" for n in names))


# --- fixed values: sentences of reports
NO_PRICE = "no price recorded for '%s'"
NO_CORRECT = "no correct answers, so cost per correct answer is undefined"
NONE_QUOTED = "no abolished slab quoted"
# ------------------------------------------------------------------------------------------------------


def _share(hit: Column, of: Column | None = None) -> Column:
    x = hit.cast("double")
    return F.coalesce(F.avg(x if of is None else F.when(of, x)), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def summary_metrics() -> list[Column]:
    """Aggregates over scored rows. Errors count against accuracy but not against headings."""
    s = F.col("score")
    graded = ~s["errored"] & ~s["unparseable"]
    is_no, said_no = s["gold"] == L.UNANSWERABLE, F.coalesce(s["predicted"] == L.UNANSWERABLE, F.lit(False))
    tp, fp, fn = F.count_if(is_no & said_no), F.count_if(~is_no & said_no), F.count_if(is_no & ~said_no)
    return [
        F.count("*").alias("n"),
        _share(s["label_correct"]).alias("label_acc"),
        _share(s["heading_correct"], graded).alias("heading_acc"),
        _share(s["chapter_correct"], graded).alias("chapter_acc"),
        _share(s["abstention_correct"]).alias("abstention_acc"),
        _share(s["retired"].isNotNull()).alias("retired_rate"),
        _share(recites_retired(s)).alias("retired_cited_rate"),
        F.count_if(s["unparseable"]).alias("unparseable"),
        F.count_if(s["errored"]).alias("errored"),
        F.count_if(graded).alias("n_graded"),
        _ratio(tp, tp + fp).alias("abstain_precision"),
        _ratio(tp, tp + fn).alias("abstain_recall"),
    ]


def summarise(scored: DataFrame, *keys: str) -> DataFrame:
    """One row of metrics for each key."""
    out = scored.groupBy(*keys).agg(*summary_metrics())
    p, r = F.col("abstain_precision"), F.col("abstain_recall")
    return out.withColumn("abstain_f1", _ratio(2 * p * r, p + r))


def rounded(summary: DataFrame, places: int = 4) -> DataFrame:
    """Rates to four places, as they are reported: ties of the binary value go to the even digit."""
    return summary.withColumns({c: F.bround(c, places) for c, t in summary.dtypes if t == "double"})


def retired_counts(scored: DataFrame, *keys: str) -> DataFrame:
    """Rows per retired label: answered, and cited or answered (each label once a row)."""
    s = F.col("score")
    both = F.array_union(s["retired_cited"], F.array_compact(F.array(s["retired"])))
    own = "_" + "_".join(["answered", *keys])  # none of the keys
    each = scored.select(*keys, F.explode(both).alias("label"), s["retired"].alias(own))
    return each.groupBy(*keys, "label").agg(F.count_if(F.col(own).eqNullSafe(F.col("label"))).alias("answered"), F.count("*").alias("cited"))


def describe_retired(counts: DataFrame, n: Column, *keys: str) -> DataFrame:
    """A line of text for each key: the rate, then each answered label with its date and count."""
    dates = F.create_map(*(F.lit(x) for pair in L.RETIRED.items() for x in pair))
    parts = F.array_sort(F.collect_list(F.when(F.col("answered") > 0, F.struct("label", "answered"))))
    line = F.array_join(F.transform(F.col("_parts"), lambda p: F.format_string("%s%% (abolished %s) ×%d", p["label"], F.element_at(dates, p["label"]), p["answered"])), ", ")
    total = counts.groupBy(*keys).agg(parts.alias("_parts"), F.sum("answered").alias("_answered"), F.first(n).alias("_n"))
    text = F.when(F.col("_answered") > 0, F.concat(F.format_string("%.1f%% — ", 100 * F.col("_answered") / F.col("_n")), line)).otherwise(F.lit(NONE_QUOTED))
    return total.select(*keys, text.alias("line"))


def nearest_rank(x: Column, p: float) -> Column:
    """Aggregate: the value of rank round-half-even(p/100 n), at least 1; null and zero values are left out; 0 without any.

    Collects a group's values: for groups of bounded size. nearest_rank_by sorts instead.
    """
    values = F.array_sort(F.collect_list(F.when(x != 0, x)))
    n = F.size(values)
    rank = F.greatest(F.lit(1), F.least(n, F.bround(F.lit(p / 100) * n).cast("int")))
    return F.coalesce(F.get(values, rank - 1), F.lit(0).cast("int"))


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, *percents: float) -> DataFrame:
    """As nearest_rank, for groups of any size: counts of distinct values, and running sums of these."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    mine = Window.partitionBy(*keys)
    run = counts.withColumns({"_cum": F.sum("_c").over(mine.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(mine)})
    aggs = []
    for p in percents:
        rank = F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.lit(p / 100) * F.col("_n")).cast("long")))
        aggs.append(F.min(F.when(F.col("_cum") >= rank, F.col("_v"))).alias(f"p{p:g}"))
    return run.groupBy(*keys).agg(*aggs)


def usage() -> list[Column]:
    """Aggregates over completions (tokens_in, tokens_out, cached_tokens_in, correct)."""
    return [*(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cached_tokens_in")), F.count("*").alias("calls"), F.count_if("correct").alias("correct")]


def priced(used: DataFrame, models: DataFrame, key: str = "model_key") -> DataFrame:
    """used (key, usage) with usd_total, usd_per_correct, inr_per_correct, unpriced_reason; models is a small dimension (key, prices, note)."""
    has = (F.col("usd_in_per_m") > 0) & (F.col("usd_out_per_m") > 0)
    usd = F.when(has, F.col("tokens_in") / 1_000_000 * F.col("usd_in_per_m") + F.col("tokens_out") / 1_000_000 * F.col("usd_out_per_m"))
    per = F.when(F.col("correct") > 0, usd / F.col("correct"))
    reason = F.when(~has, F.coalesce(F.nullif(F.col("note"), F.lit("")), F.format_string(NO_PRICE, F.col(key)))).when(F.col("correct") == 0, F.lit(NO_CORRECT))
    df = used.join(models.select(key, "usd_in_per_m", "usd_out_per_m", "note"), key)
    money = {"usd_total": usd, "usd_per_correct": per, "inr_per_correct": per * L.RUPEES, "unpriced_reason": reason}
    return df.select(*used.columns, *(c.alias(n) for n, c in money.items()))


def cost_report(completions: DataFrame, models: DataFrame, key: str = "model_key") -> DataFrame:
    """Tokens, calls, cost and latency for each model; models is a small dimension (key, prices, note)."""
    late = nearest_rank_by(completions, [key], "latency_ms", 50, 95)
    df = priced(completions.groupBy(key).agg(*usage()), models, key).join(late, key, "left")
    columns = (key, "tokens_in", "tokens_out", "cached_tokens_in", "calls", "correct", "usd_total", "usd_per_correct", "inr_per_correct")
    return df.select(*columns, F.coalesce("p50", F.lit(0)).alias("p50_latency_ms"), F.coalesce("p95", F.lit(0)).alias("p95_latency_ms"), "unpriced_reason")


def leaderboard(scored: DataFrame, models: DataFrame, key: str = "model_key") -> DataFrame:
    """Summary and cost of each model, with its rank: one pass over the scored rows. scored has usage's columns too."""
    rows = scored.groupBy(key).agg(*summary_metrics(), *usage())
    return rank_runs(priced(rows, models, key), order=key)


def estimate(models: DataFrame, rows: int, tokens_in: int = 700, tokens_out: int = 250) -> DataFrame:
    """What a run over so many rows would cost; unpriced models add nothing."""
    usd = rows * (tokens_in / 1_000_000 * F.col("usd_in_per_m") + tokens_out / 1_000_000 * F.col("usd_out_per_m"))
    return models.select("model_key", usd.alias("usd_estimate"))


def rank_runs(runs: DataFrame, cost: str = "inr_per_correct", accuracy: str = "label_acc", order: str = "model_key") -> DataFrame:
    """Adds rank: priced runs by cost, then accuracy; unpriced ones last, by accuracy. One row for each model, so few."""
    w = Window.orderBy(F.col(cost).isNull(), F.col(cost), F.desc(accuracy), order)
    return runs.withColumn("rank", F.row_number().over(w))


def latest_per_model(runs: DataFrame, key: str, started: str, tie: str, mode: str | None = None) -> DataFrame:
    """The newest run of each model (of one prompt mode); of equal times the smaller tie."""
    df = runs if mode is None else runs.where(F.col("prompt_mode") == mode)
    w, r = Window.partitionBy(key).orderBy(F.desc(started), tie), fresh(df, "_rank")
    return df.withColumn(r, F.row_number().over(w)).where(F.col(r) == 1).drop(r)


def running_accuracy(scored: DataFrame, key: str, order: str, correct: str, every: int = 25) -> DataFrame:
    """Cumulative accuracy at every 25th row and the last one of each key. Few keys may have all rows: see placed."""
    rows = scored.select(F.col(key), F.col(order).alias("_order"), F.col(correct).cast("long").alias("_hit"))
    df = placed(rows, {"_key": F.col(key)}, ["_order"], "i", {"_hits": F.col("_hit")})
    return df.where((F.col("i") % every == 0) | (F.col("i") == F.col("i_of"))).select(key, "i", (F.col("_hits") / F.col("i")).alias("accuracy"))


def label_matrix(scored: DataFrame) -> DataFrame:
    """gold x predicted counts; no prediction counts as unparsed."""
    s = F.col("score")
    return scored.groupBy(s["gold"].alias("gold"), F.coalesce(F.nullif(s["predicted"], F.lit("")), F.lit("unparsed")).alias("predicted")).agg(F.count("*").alias("n"))


def label_order(label: Column) -> list[Column]:
    """Numbers by value, then the sentinels."""
    n = label.try_cast("double")
    return [n.isNull(), n, label]
