"""Questions to run tables and their upkeep, as DataFrames over append-only Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe.operators.keyed import number_by_range, top_n
from traceframe.sources.tables import merge_keyed


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row per key; partial aggregation leaves one row per key and task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def list_projects(runs: DataFrame, folder: str = "project_dir", order: str = "run_id") -> DataFrame:
    """Newest run per project folder, newest first."""
    return latest(runs.filter(F.coalesce(folder, F.lit("")) != ""), [folder], order).orderBy(F.desc(order))


def recent(df: DataFrame, order: str, limit: int = 20, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.orderBy(F.desc(order)).limit(limit)


def search_lessons(lessons: DataFrame, query: str = "", scope: str = "", limit: int = 10) -> DataFrame:
    """Lessons that contain the query in title, text or tags; newest first."""
    out = lessons
    if query.strip():
        q = query.strip().lower()
        out = out.filter(F.lower("title").contains(q) | F.lower("lesson").contains(q) | F.lower("tags").contains(q))
    if scope.strip():
        out = out.filter(F.col("scope") == scope.strip())
    return out.orderBy(F.desc("created_at")).limit(limit)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Updated rows replace those with the same key, new ones are added. With ``order`` the
    last of several updates of a key counts."""
    new = latest(updates, keys, order) if order else updates
    both = base.withColumn("_u", F.lit(0)).unionByName(new.select(*[c for c in new.columns if c in base.columns]).withColumn("_u", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_u").alias("_r")).select(*keys, "_r.*")


def upsert_into(path: str, updates: DataFrame, keys: list[str], order: str | None = None, buckets: int = 64) -> list[int]:
    """``upsert`` into a stored keyed table: only the buckets that hold a key of the updates are read and replaced. Returns them."""
    new = latest(updates, keys, order) if order else updates
    return merge_keyed(new, path, keys, lambda old, own: own if old is None else upsert(old, own.select(*old.columns), keys), buckets)


def cascade_delete(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str, str]], root: str, key: str, doomed: DataFrame,
                   busy: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without what belongs to the doomed roots.

    parents: child -> (parent table, parent key, child column), parents first. Roots listed
    in ``busy`` stay. Each level takes its deleted keys from the level above."""
    gone = doomed.select(key).distinct()
    if busy is not None:
        gone = gone.join(busy.select(key).distinct(), key, "left_anti")
    deleted = {root: tables[root].join(gone, key, "left_semi")}
    out = {root: tables[root].join(gone, key, "left_anti")}
    for child, (parent, parent_key, column) in parents.items():
        keys = deleted[parent].select(F.col(parent_key).alias(column)).distinct()
        deleted[child] = tables[child].join(keys, column, "left_semi")
        out[child] = tables[child].join(keys, column, "left_anti")
    return out


def revision_history(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Revision number of every change and the place where the next one replaced it, in one pass over sampled ranges: a key with many
    changes and ids without any density stay parallel."""
    numbered = number_by_range(changes, keys, [F.col(order)], "revision", {"valid_to": order})
    return numbered.withColumn("is_current", F.col("valid_to").isNull())


def model_differences(primary: DataFrame, review: DataFrame, on: str = "source_path") -> DataFrame:
    """Sources for which the second model's answer is not the first one's."""
    p = primary.select(on, F.col("model").alias("primary_model"), F.col("result").alias("primary_result"))
    r = review.select(on, F.col("model").alias("review_model"), F.col("result").alias("review_result"))
    return p.join(r, on).filter(~F.col("primary_result").eqNullSafe(F.col("review_result"))).withColumn("status", F.lit("open"))


def model_run_log(runs: DataFrame) -> DataFrame:
    """Rows to append to the log: model, task, basis and outcome."""
    return runs.select("run_id", "role", "model", "task_type", F.to_json("input_basis").alias("input_basis"), "status",
                       F.coalesce("error", F.lit("")).alias("error"), F.current_timestamp().alias("created_at"))


def lookup(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows for many keys at once; ``found`` is false for keys without a row."""
    marked = table.withColumn("found", F.lit(True))
    return keys.select(on).distinct().join(marked, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def patch(table: DataFrame, updates: DataFrame, key: str, stamp: str | None = None, order: str | None = None):
    """Supplied (non-null) fields replace stored ones. Returns the table and updates without
    a row. Of several updates of a key the last in ``order`` counts, without it the greatest."""
    fields = [c for c in updates.columns if c not in (key, order)]
    best = F.max_by(F.struct(*fields), order) if order else F.max(F.struct(*fields))
    updates = updates.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = table.join(u, key, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    if stamp:
        out = out.withColumn(stamp, F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col(stamp)))
    return out.drop(*[f"_{c}" for c in fields], "_hit"), updates.join(table.select(key), key, "left_anti")


def search_review(items: DataFrame, query: str) -> DataFrame:
    return items.filter(F.concat("title", "detail").contains(query))


def top_open(items: DataFrame, by: list[str], order: list, n: int = 5) -> DataFrame:
    return top_n(items.filter("status = 'open'"), by, order, n)


def confirm_facts(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """A person's value replaces the first fact of its key, or is added. facts: ``project,
    key, value, unit, ord``; decisions: ``project, key, value, unit``."""
    first = facts.groupBy("project", "key").agg(F.min("ord").alias("ord"))
    best = decisions.groupBy("project", "key").agg(F.max(F.struct("value", "unit")).alias("_d"))  # one decision of a key counts, the greatest
    d = best.select("project", "key", F.col("_d.value").alias("_v"), F.col("_d.unit").alias("_u"))
    hit = first.join(d, ["project", "key"])
    out = facts.join(hit, ["project", "key", "ord"], "left")
    mine = F.col("_v").isNotNull()
    old = out.select("project", "key", "ord", F.coalesce("_v", "value").alias("value"), F.when(mine, F.col("_u")).otherwise(F.col("unit")).alias("unit"),
                     F.when(mine, "confirmed").otherwise(F.col("status")).alias("status"))
    new = d.join(first, ["project", "key"], "left_anti").select(
        "project", "key", F.lit(None).cast("bigint").alias("ord"), F.col("_v").alias("value"), F.col("_u").alias("unit"), F.lit("confirmed").alias("status"))
    return old.unionByName(new)
