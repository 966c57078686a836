"""Files and reports: appended rows, run documents, safe rewrites, the leaderboard, agreement notes."""

from __future__ import annotations

import html
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> int:
    """Append rows as JSON lines; null fields are left out. Returns how many rows were written, counted as they are."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").option("ignoreNullFields", "true").json(path)
    return seen.get["n"]


def new_run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")


def run_date(started_at: Column) -> Column:
    """The day of a run's start: the first ten characters of its time."""
    return F.substring(started_at, 1, 10)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document for each row, in a folder."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("errorifexists").text(path)


def save_document(df: DataFrame, path: str) -> str:
    """The one row of df as one JSON file, in any store; an existing file raises. Returns the path."""
    rows = df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).take(2)
    if len(rows) != 1:
        raise ValueError("a document has one row")
    p, fs = _path(df.sparkSession, path)
    out = fs.create(p, False)
    try:
        out.write((rows[0].value + "\n").encode())
    finally:
        out.close()
    return path


def save_run(run: DataFrame, folder: str) -> str:
    """A run (one row with run_id) as folder/{run_id}.json."""
    return save_document(run, f"{folder.rstrip('/')}/{run.select('run_id').first()[0]}.json")


# --- fixed value: the field of a probe's document that says what it isn't
DISCLAIMER = "NOT_THE_GOLDEN_SET"


def probe_document(aggregate: DataFrame, summaries: DataFrame, rows: DataFrame, disclaimer: str, model_key: str, model_id: str, prompt_version: str, started_at: str, finished_at: str, run: str = "run") -> DataFrame:
    """One row that holds a probe: what it is not, its model and times, the last run's summary and rows, the aggregate, all runs' summaries.

    summaries: a row for each run; rows: scored rows with their run. For sets that one can read.
    """
    facts = {"model_key": model_key, "model_id": model_id, "prompt_version": prompt_version, "started_at": started_at, "finished_at": finished_at}
    whole = F.struct(*(c for c in summaries.columns if c != run))
    last = summaries.agg(F.max(run).alias("last"))
    runs = summaries.agg(F.max_by(whole, run).alias("summary"), F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), whole.alias("summary")))).alias("all_runs"))
    own = rows.join(F.broadcast(last), F.col(run) == F.col("last")).agg(F.collect_list(F.struct(*(c for c in rows.columns if c != run))).alias("rows"))
    out = runs.crossJoin(own).crossJoin(aggregate.select(F.struct("*").alias("aggregate")))  # one row each
    return out.select(F.lit(disclaimer).alias(DISCLAIMER), *(F.lit(v).alias(k) for k, v in facts.items()), "summary", "rows", "aggregate", "all_runs")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def rewrite(df: DataFrame, path: str, dry_run: bool = False) -> bool:
    """Replace a folder of JSON lines by df, keeping what was there as path.bak; nothing happens on a dry run or if rows are the same.

    Readers of path that begin between both renames find nothing there; pool.rewrite_pool has no such moment.
    df may read path: it is written beside it first. An older path.bak goes last, when the new rows
    are in place, so at no time is there less than one whole copy.
    """
    spark = df.sparkSession
    fresh = f"{path}.new"
    df.write.mode("overwrite").json(fresh)
    old, new = spark.read.schema(df.schema).json(path), spark.read.schema(df.schema).json(fresh)
    same = old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()
    (here, fs), (new_at, _), (backup, _), (older, _) = (_path(spark, path + end) for end in ("", ".new", ".bak", ".bak.old"))
    if dry_run or same:
        fs.delete(new_at, True)
        return False
    fs.delete(older, True)
    if fs.exists(backup):
        fs.rename(backup, older)
    fs.rename(here, backup)
    fs.rename(new_at, here)
    fs.delete(older, True)
    return True


#: What a board shows of a ranked run, in this order, of the columns that it has.
BOARD = ("rank", "model_key", "served_model_id", "tier", "label_acc", "heading_acc", "abstain_f1", "retired_rate", "retired", "inr_per_correct", "usd_total", "p50_latency_ms", "run_date", "drifted")


def board_rows(ranked: DataFrame, dataset_sha: str) -> DataFrame:
    """The columns that a board shows of ranked runs: drifted marks those scored on another dataset, run_date is the day they began."""
    has = set(ranked.columns)
    df = ranked
    if "dataset_sha" in has:
        df = df.withColumn("drifted", (F.coalesce("dataset_sha", F.lit("")) != "") & F.lit(dataset_sha != "") & (F.coalesce("dataset_sha", F.lit("")) != F.lit(dataset_sha)))
    if "started_at" in has:
        df = df.withColumn("run_date", run_date(F.col("started_at")))
    if {"served_model_id", "model_id"} <= has:
        df = df.withColumn("served_model_id", F.coalesce(F.nullif("served_model_id", F.lit("")), F.col("model_id")))
    return df.select(*(c for c in BOARD if c in df.columns)).orderBy("rank")


def leaderboard_html(ranked: DataFrame, title: str = "Leaderboard") -> str:
    """An HTML table of ranked runs: one row for each model."""
    rows = ranked.orderBy("rank").collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in ranked.columns)
    body = "".join("<tr>" + "".join(f"<td>{'—' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def agreement_markdown(kappa: DataFrame, confusion: DataFrame, title: str) -> str:
    """A note of one kappa row and its confusion matrix."""
    k = kappa.first()
    if k is None:
        return f"# {title}\n\nNo pairs.\n"
    cells = {(r.a, r.b): r.n for r in confusion.collect()}
    labels = sorted({a for a, _ in cells})
    lines = [f"# {title}", "", f"n {k.n}, observed {k.observed:.4f}, expected {k.expected:.4f}, kappa {k.kappa:.4f}: {k.reading}", "", "| | " + " | ".join(map(str, labels)) + " |", "|-" * (len(labels) + 1) + "|"]
    lines += [f"| {a} | " + " | ".join(str(cells[a, b]) for b in labels) + " |" for a in labels]
    return "\n".join(lines) + "\n"


def self_agreement_markdown(fields: dict[str, DataFrame], matrix: DataFrame, disagreements: DataFrame, floor: float) -> str:
    """A report on labels given twice: kappa of each field, whether the first one's agreement reaches the floor, its matrix, and every row labelled otherwise.

    fields: name -> one row of cohen_kappa, the label's first; disagreements: id, gold_label, label, input.
    """
    notes = {name: k.first() for name, k in fields.items()}
    lines = ["# Self-agreement", "", "| Field | n | Agreement | Kappa | Reading |", "|---|---|---|---|---|"]
    lines += [f"| {name} | 0 | | | |" if k is None else f"| {name} | {k.n} | {k.observed:.1%} | {k.kappa:.3f} | {k.reading} |" for name, k in notes.items()]
    label, k = next(iter(notes.items()))
    passed = k is not None and k.observed >= floor
    lines += ["", f"Agreement on {label}: {'reaches' if passed else 'is below'} {floor:.0%}.", "", agreement_markdown(fields[label], matrix, f"{label}, first against second")]
    for r in disagreements.select("id", "gold_label", "label", F.substring("input", 1, 240).alias("input")).orderBy("id").toLocalIterator():
        lines += [f"- `{r.id}` {r.gold_label} -> {r.label}: {r.input}"]
    return "\n".join(lines) + "\n"


def judge_markdown(pairs: DataFrame, kappa: DataFrame, matrix: DataFrame, directions: DataFrame, judge: str, rubric: str) -> str:
    """A report on a judge: agreement with human verdicts, which way it errs, and each disagreement.

    pairs: example_id, human, judge, and whatever else is to be shown of a disagreement.
    """
    head = f"# Judge\n\n{judge}, rubric {rubric}\n"
    if kappa.first() is None:
        return head + "\nNo pairs.\n"
    d = directions.first()
    way = "too lenient" if d.lenient > d.strict else "too strict" if d.strict > d.lenient else "even"
    lines = [head, agreement_markdown(kappa, matrix, "Human against judge"), f"Lenient {d.lenient}, strict {d.strict}: {way}.", ""]
    for r in pairs.where("human <> judge").orderBy("example_id").toLocalIterator():
        lines += [f"- `{r.example_id}` human {r.human}, judge {r.judge}" + "".join(f"; {c}: {r[c]}" for c in pairs.columns if c not in ("example_id", "human", "judge") and r[c] is not None)]
    return "\n".join(lines) + "\n"
