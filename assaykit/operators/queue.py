"""The labelling pool: dedupe, drop reasons, selection, interleaving, batches. pos is a row's place in stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.text import candidate_families, dedupe_key
from assaykit.operators.ordering import placed
from assaykit.shared import checkpointed, fresh


def first_wins(df: DataFrame, key: Column, pos: str = "pos", protected: Column | None = None) -> DataFrame:
    """The first row of each key. Protected rows all stay, and hold their key for rows after them.

    An empty or null key is a key like any other. pos tells rows apart. Each key's first pos is a
    partial minimum before it is sent, so a key that most rows have is no task's burden; rows are then
    looked up by pos.
    """
    at, first = fresh(df, "_pos"), fresh(df, "_first")
    firsts = df.groupBy(key).agg(F.min(pos).alias(at)).select(at, F.lit(True).alias(first))
    if protected is None:
        return df.join(firsts, F.col(pos) == F.col(at), "left_semi")
    marked = df.join(firsts, F.col(pos) == F.col(at), "left")
    return marked.where(F.coalesce(F.col(first), F.lit(False)) | F.coalesce(protected, F.lit(False))).select(*(df[c] for c in df.columns))


#: Rows of one component that are settled in a task; larger components are settled in rounds.
COMPONENT_ROWS = 200_000


def greedy_two_keys(df: DataFrame, first: str, second: str, pos: str = "pos", most: int = COMPONENT_ROWS) -> DataFrame:
    """Rows in order, each kept if neither key was kept before; a dropped row holds neither. A null key is a key like any other.

    Rows without an earlier row of either key are kept at once, and what shares a key with them goes: copies and
    shared keys, however many, are settled by partial minima. What is left falls into components of rows that share
    keys, found by stars over keys alone; each of at most `most` rows is settled by the loop itself, in one task
    that sees positions and digests of keys only, so a chain of rows is one step, however long. Larger components are
    settled in rounds, each of which takes the first rows left of both their keys. Rows are looked up by pos,
    which tells them apart.
    """
    spark, names = df.sparkSession, [fresh(df, n) for n in ("_p", "_x", "_y")]
    p, x, y = names
    key = lambda kind, c: F.unhex(F.md5(F.concat(F.lit(kind), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))))  # noqa: E731  16 bytes for a key of any length
    rows = checkpointed(df.select(F.col(pos).alias(p), key("1", first).alias(x), key("2", second).alias(y)))
    kept, left = _first_rows(rows, names)
    if not left.isEmpty():
        of = _key_components(left.select(F.col(x).alias("a"), F.col(y).alias("b")))
        left = left.join(of, F.col(x) == F.col("node")).drop("node")
        large = left.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > most).select("label")
        large = checkpointed(large)
        small = left.join(large, "label", "left_anti").select("label", *names)

        def settle(table):
            """The loop over one component's rows, in order."""
            t = table.sort_by(p)
            held, out = set(), []
            for k, (i, j) in enumerate(zip(t.column(x).to_pylist(), t.column(y).to_pylist(), strict=True)):
                if (1, i) not in held and (2, j) not in held:
                    held |= {(1, i), (2, j)}
                    out.append(k)
            return t.select([p]).take(out)

        done = small.groupBy("label").applyInArrow(settle, T.StructType([rows.schema[p]]))
        kept = [*kept, checkpointed(done)]
        left = checkpointed(left.join(large, "label", "left_semi").select(*names))
        while not left.isEmpty():
            some, left = _first_rows(left, names)
            kept += some
    found = kept[0]
    for k in kept[1:]:
        found = found.unionByName(k)
    return df.join(found, F.col(pos) == F.col(p), "left_semi")


def _first_rows(rows: DataFrame, names: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(positions of rows that come first of both keys, what is left without them and what shares a key with them)."""
    p, x, y = names
    win = rows
    for k in (x, y):
        win = win.join(rows.groupBy(k).agg(F.min(p).alias("_at")).select("_at"), F.col(p) == F.col("_at"), "left_semi")
    win = checkpointed(win)
    left = rows
    for k in (x, y):
        left = left.join(win.select(F.col(k).alias("_gone")), F.col(k) == F.col("_gone"), "left_anti")
    return [win.select(p)], checkpointed(left)


def _key_components(edges: DataFrame) -> DataFrame:
    """(node, label): the component of each first key, by large and small stars over (a, b); a label is one of its keys.

    Edges end as stars around each component's smallest key, in about the logarithm of its diameter rounds.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if mark == last:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return checkpointed(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()))


def drop_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Counts by the first rule that holds; 'kept' for rows that none takes."""
    reason = F.coalesce(*(F.when(hit, F.lit(name)) for name, hit in rules), F.lit("kept"))
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def interleave(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """Adds turn and group_first: one row of each group in turn, groups in the order of their first row.

    pos tells rows apart. Places are found for (group, pos) alone and looked up by pos, so no other column is
    sorted, checkpointed, or read for a caller that doesn't want it.
    """
    g, at, of = fresh(df, "_group"), fresh(df, "_pos"), fresh(df, "_of")
    narrow = df.select(key.alias(g), F.col(pos).alias(at))
    firsts = narrow.groupBy(F.col(g).alias(of)).agg(F.min(at).alias("group_first"))
    places = placed(narrow, {g: F.col(g)}, [at], "turn").select(g, at, "turn").join(firsts, F.col(g).eqNullSafe(F.col(of))).select(at, "turn", "group_first")
    return df.join(places, F.col(pos) == F.col(at)).drop(at)


def state_key(state: Column) -> Column:
    return F.coalesce(F.nullif(state, F.lit("")), F.lit("(unknown)"))


def unlabelled(pool: DataFrame, labelled: DataFrame, key: str = "source_id") -> DataFrame:
    done = labelled.where(F.coalesce(F.col(key), F.lit("")) != "").select(key).distinct()
    return pool.join(done, key, "left_anti")


def protected_flag(pool: DataFrame, labelled: DataFrame, key: str = "source_id") -> DataFrame:
    own, hit = fresh(pool, "_id"), fresh(pool, "_hit")
    ids = labelled.select(F.col(key).alias(own)).distinct().withColumn(hit, F.lit(True))
    return pool.join(ids, F.col(key) == F.col(own), "left").withColumn("protected", F.coalesce(hit, F.lit(False))).drop(own, hit)


def select_queue(
    pool: DataFrame,
    labelled: DataFrame,
    keyword: str = "",
    source: str = "",
    stale: str = "",
    changed_candidates: bool = False,
    state: str = "",
    exclude_state: str = "",
    spread_states: bool = False,
    limit: int = 0,
) -> DataFrame:
    """The queue in order. pool: source_id, source, text, state, stale_rates, categories, pos, and labels if it has them.

    Filters apply in this order: done, source, stale rate, state, excluded state, candidates (one of
    each family in turn), keyword; then one of each state in turn if asked; 0 means no limit.
    """
    df = unlabelled(pool, labelled)
    if source:
        df = df.where(F.col("source") == source)
    if stale:
        df = df.where(F.array_contains(F.coalesce("stale_rates", F.array().cast("array<string>")), stale))
    s = F.lower(F.coalesce("state", F.lit("")))
    if state:
        df = df.where(s.contains(state.lower()))
    if exclude_state:
        df = df.where(~s.contains(exclude_state.lower()))
    order = [F.col("pos")]
    if changed_candidates:
        families = candidate_families(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("text", "categories", "labels") if c in df.columns)))
        f = fresh(df, "_families")
        df = interleave(df.withColumn(f, families).where(F.size(f) > 0), F.get(f, F.lit(0))).drop(f)
        order = [F.col("turn"), F.col("group_first")]
    if keyword:
        df = df.where(F.lower("text").contains(keyword.lower()))
    if spread_states:
        whole = fresh(df, "_order")
        df = df.withColumn(whole, F.struct(*order)).drop("turn", "group_first")
        df = interleave(df, state_key(F.col("state")), whole).drop(whole)
        order = [F.col("turn"), F.col("group_first")]
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def content_key(text: Column, capped: bool = True) -> Column:
    return dedupe_key(text) if capped else dedupe_key(text, None)


def batch_place(df: DataFrame, order: str, size: int = 50) -> DataFrame:
    """Adds batch and place (from 1) of each row in batches of `size`."""
    turn = fresh(df, "_turn")
    out = placed(df, {}, [order], turn).drop(f"{turn}_of")
    return out.withColumns({"batch": F.floor((F.col(turn) - 1) / size), "place": (F.col(turn) - 1) % size + 1}).drop(turn)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by a hash of key and seed: the same on every run. Fewer rows raise."""
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
