"""Keyed building blocks that stay parallel when one key holds most of the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceframe.functions.text import let

SALTS = 32
BROADCAST_ROWS = 100_000


def top_n(df: DataFrame, keys: list, order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark prunes to ``n`` rows per key inside every map
    task before the shuffle (WindowGroupLimit), so a hot key moves few rows."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= n
    )
    return out if rank else out.drop(name)


def unfold(df: DataFrame, keep: list, items: Column, out: str) -> DataFrame:
    """Columns ``keep`` and one row per item of an array; null items are left out.

    For an inner ``explode`` Spark infers the filter ``size(items) > 0`` and pushes it below all projections, where every column that
    the array was made of is computed again, those used inside a lambda once for each element. The outer form has no such filter."""
    return df.select(*keep, F.explode_outer(items).alias(out)).filter(F.col(out).isNotNull())


def running_total(df: DataFrame, group: list[str], order: list, value: Column, out: str, chunk: Column) -> DataFrame:
    """Inclusive running sum of ``value`` in ``group`` along ``order``.

    ``chunk`` is an integer that never falls along ``order``. Rows are summed inside
    (group, chunk), and only one total per chunk is summed along the whole group, so no
    task sees all rows of a large group. Both steps read the rows that were kept, so that
    they are made once."""
    cut = kept(df.withColumn("_chunk", chunk).withColumn("_v", value.cast("bigint")))
    inner = cut.withColumn("_in", F.sum("_v").over(Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*group, "_chunk").agg(F.sum("_v").alias("_t"))
        .withColumn("_off", F.sum("_t").over(before)).filter(F.col("_off").isNotNull()).drop("_t")
    )
    return (
        inner.join(offsets, [*group, "_chunk"], "left")
        .withColumn(out, F.col("_in") + F.coalesce("_off", F.lit(0)))
        .drop("_chunk", "_v", "_in", "_off")
    )


def number_rows(df: DataFrame, group: list[str], order: list, out: str, chunk: Column | None = None) -> DataFrame:
    """1-based position in ``group``. Without ``chunk`` the group must be bounded, such as
    the lines of one text cell; with it see ``running_total``."""
    if chunk is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return running_total(df, group, order, F.lit(1), out, chunk)


def checkpoint_folder(spark) -> str:
    """The shared checkpoint folder: the session's own, else ``spark.checkpoint.dir``. A
    local temporary folder serves only local sessions that name none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="traceframe-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: the rows are computed once for several
    uses, and ids taken from the physical layout stay the same when tasks run again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``stable`` for many rows: a compressed table in the shared checkpoint folder, of which later steps read the columns they need.
    Shuffle files that only its rows needed go as soon as the driver's JVM collects its garbage. Columns without a type need a checkpoint."""
    if any(f.dataType.typeName() == "void" for f in df.schema):
        return stable(df)
    path = f"{checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_by_range(df: DataFrame, group: list[str], order: list, out: str, following: dict[str, str] | None = None) -> DataFrame:
    """1-based position in ``group`` for any sort order, any spread of the ordered values and any group size; ``following`` (new name ->
    column) adds values of the next row of the group.

    Rows are range-partitioned by (group, order) between splitters that Spark samples, and kept that way; positions are counted
    per partition. Only groups that cross a partition border need a carry, at most two
    per partition, which bounds the broadcast."""
    following = following or {}
    spread = stable(
        df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    place = F.row_number().over(inside)
    inner = spread.select("*", place.alias("_in"), *[F.lead(F.struct(c)).over(inside).alias(f"_next_{n}") for n, c in following.items()])
    heads = inner.select(*group, "_part", "_in", *[F.struct(c).alias(f"_head_{n}") for n, c in following.items()])
    ends = heads.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min_by(f"_head_{n}", "_in").alias(f"_head_{n}") for n in following])
    parts = Window.partitionBy(*group).orderBy("_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*group, "_part", F.sum("_n").over(before).alias("_off"), *[F.lead(f"_head_{n}").over(parts).alias(f"_over_{n}") for n in following])
    crossing = F.col("_off").isNotNull()
    for n in following:
        crossing = crossing | F.col(f"_over_{n}").isNotNull()
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*group, "_part"]]
    both = inner.alias("i").join(F.broadcast(carry.filter(crossing)).alias("c"), same, "left")
    return both.select(
        *[F.col(f"i.{c}") for c in df.columns], (F.col("_in") + F.coalesce("_off", F.lit(0))).alias(out),
        *[F.coalesce(f"_next_{n}", f"_over_{n}")[c].alias(n) for n, c in following.items()])


def known_around(df: DataFrame, keys: list[str], at: str, value: str, chunk: Column, whole: dict[str, Column]) -> DataFrame:
    """As-of lookup both ways: ``below``, the last known ``value`` at or before a row's place in its group, and ``above``, the first at or
    after it, with aggregates over the ``whole`` group (columns of min, max or sum form: name -> aggregate of that name's column).

    ``chunk`` is an integer that never falls along ``at``. Both directions are running frames inside (group, chunk); what lies
    beyond the borders is carried by one row per chunk, so that a group of any size is cut into tasks. Groups that lie in chunk 0 as a whole
    have no border and take no part in that, so their rows are shuffled once. ``df`` is read several times and should be ``kept``;
    rows with a null in the keys or in ``at`` are left out."""
    rows = df.withColumn("_chunk", chunk).dropna(subset=[*keys, "_chunk"])
    part = Window.partitionBy(*keys, "_chunk")
    up = part.orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, 0)
    inner = rows.select("*", F.last(value, True).over(up).alias("_below"), F.last(value, True).over(down).alias("_above"),
                        *[a.over(part).alias(f"_own_{n}") for n, a in whole.items()])
    place = F.when(F.col(value).isNotNull(), F.col(at))
    far = bounded(rows.filter("_chunk <> 0").select(*keys).distinct())
    ends = rows.join(far, keys, "left_semi").groupBy(*keys, "_chunk").agg(
        F.max_by(value, place).alias("_last"), F.min_by(value, place).alias("_first"), *[a.alias(n) for n, a in whole.items()])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_chunk", F.last("_last", True).over(before).alias("_b"), F.last("_first", True).over(after).alias("_a"),
                        *[a.over(group).alias(f"_all_{n}") for n, a in whole.items()])
    out = inner.join(carry, [*keys, "_chunk"], "left")
    # the own values of a chunk are among those of its group
    return out.select(*df.columns, *[F.coalesce(f"_all_{n}", f"_own_{n}").alias(f"all_{n}") for n in whole],
                      F.coalesce("_below", "_b").alias("below"), F.coalesce("_above", "_a").alias("above"))


def salted_lookup(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", by: list[str] | None = None, salts: int = SALTS, tasks: int | None = None
) -> DataFrame:
    """Join rows to a table with one row per key. Each key of ``left`` is spread over
    ``salts`` tasks by a hash of the columns ``by`` (a row's own id, so that a task that
    runs again sends it to the same place), and ``right`` is repeated once per salt. With ``tasks`` so many tasks do it, even if the rows
    are few, for rows that become many behind the join."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*(by or left.columns)), F.lit(salts)).cast("int"))
    if tasks is not None:
        spread = spread.repartition(tasks, *on, "_salt")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting that the table has at most ``rows`` rows;
    otherwise leave the choice to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


LIST_KEYS = 1000


def only_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs in ``known``. Counted few keys are a list inside a filter, which Spark pushes below the projections that
    make the other columns; more than that are a semi join."""
    ids = known.select(key).filter(F.col(key).isNotNull()).distinct()
    if ids.limit(LIST_KEYS + 1).count() > LIST_KEYS:
        return df.join(ids, key, "left_semi")
    return df.filter(F.array_contains(ids.agg(F.collect_set(key)).scalar(), F.col(key)))


def in_order(value: Column, *order: Column) -> Column:
    """Aggregate: values of a bounded group as an array in ``order``."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"])


def shingles(text: Column, size: int) -> Column:
    """Distinct character n-grams, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _probes(needle: Column, size: Column, probes: int) -> Column:
    """Up to ``probes`` n-grams of a needle, evenly spread from its first to its last one."""
    last = F.length(needle) - size
    at = lambda i: (F.lit(1) + F.floor(i * last / F.lit(max(probes - 1, 1)))).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.substring(needle, at(i), size)))


def _bitmap(keys: DataFrame, key: Column, bits: int) -> Column:
    """A bitmap of hashed keys as a scalar subquery: an array of ``bits`` / 64 numbers, whatever the number of keys."""
    slot = F.pmod(key, F.lit(bits))
    words = keys.select(F.shiftright(slot, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int")).alias("w"))
    dense = keys.sparkSession.range(bits >> 6).select("id", F.lit(0).cast("bigint").alias("w"))
    rows = words.unionByName(dense).groupBy("id").agg(F.bit_or("w").alias("w"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"])).scalar()


def _maybe(bitmap: Column, key: Column, bits: int) -> Column:
    slot = F.pmod(key, F.lit(bits))
    word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def maybe_in(df: DataFrame, wanted: DataFrame, on: list[str], bits: int = 1 << 20) -> DataFrame:
    """Rows whose columns ``on`` may occur in ``wanted``, by a bitmap of fixed size: none that does is lost, and nothing is shuffled. Rows
    with a null there are kept."""
    key = F.xxhash64(*on)
    return df.filter(_maybe(_bitmap(wanted.select(*on).distinct(), key, bits), key, bits))


NEEDLE_LIST, NEEDLE_ROWS = 1000, 20_000


def list_sizes(rows: DataFrame, on: list[str]) -> tuple[int, int, int]:
    """Rows of the largest key, all rows and keys, counted."""
    n = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return tuple(n.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())


def join_lists(left: DataFrame, lists: DataFrame, on: list[str], how: str, rows: int, keys: int, by: list[str] | None = None) -> DataFrame:
    """Join short lists, one per key, to the rows of their key: by broadcast if they are counted few, with the rows of a key spread if the keys
    are few, else by the key."""
    if rows <= NEEDLE_ROWS:
        return left.join(F.broadcast(lists), on, how)
    return salted_lookup(left, lists, on, how, by) if keys <= NEEDLE_ROWS else left.join(lists, on, how)


def _listed_pairs(distinct: DataFrame, texts: DataFrame, needle: str, text: str, on: list[str], rows: int, keys: int) -> DataFrame:
    """Texts with the needles of their key, which travel to them as one list and are looked for inside the row."""
    lists = distinct.groupBy(*on).agg(F.collect_set("_needle").alias("_list"))
    if on:
        rows = join_lists(texts, lists, on, "inner", rows, keys)
    else:
        rows = texts.withColumn("_list", lists.select("_list").scalar())
    # the text is named outside the inner lambda, so that it is made once and not for each needle
    held = let(F.col(text), lambda t: F.filter("_list", lambda n: F.contains(t, n)))
    return unfold(rows, texts.columns, held, needle)


def substring_pairs(
    needles: DataFrame, texts: DataFrame, needle: str, text: str, on: list[str] = (), sizes=(12, 4, 2, 1), probes: int = 8,
    splits: int = SALTS, bits: int = 1 << 20
) -> DataFrame:
    """Pairs where the needle occurs in the text; columns of both sides. Equal needles of a key count once, unless they have other columns.

    An inverted index of n-grams, in one plan for any number of needles: the frequencies of a few n-grams of every needle are counted over
    the texts, and the needle is filed under its rarest one. Texts file those n-grams only that some needle asks for; a bitmap of fixed
    size drops nearly all others inside the scan, before anything is shuffled. Lists are split by text over ``splits``
    tasks. Candidates carry keys, the text joins them at the end, where they are verified."""
    on = list(on)
    wanted = needles.filter(F.length(needle) > 0)
    distinct = wanted.select(*on, F.col(needle).alias("_needle")).distinct()
    size = F.lit(None).cast("int")
    for n in sorted(sizes):
        size = F.when(F.length("_needle") >= n, F.lit(n)).otherwise(size)
    keyed = distinct.withColumn("_size", size)
    keyed = keyed.select(*on, "_needle", F.explode(_probes(F.col("_needle"), F.col("_size"), probes)).alias("_gram"))
    used = distinct.agg(F.collect_set(size)).scalar()  # n-gram sizes that occur among the needles
    key = F.xxhash64(*on, "_gram")
    rows = texts.select(*on, F.col(text).alias("_text"), F.xxhash64(*texts.columns).alias("_t1"), F.xxhash64(F.lit(1), *texts.columns).alias("_t2"))
    none = F.array().cast("array<string>")
    grams = F.flatten(F.array(*[F.when(F.array_contains(used, n), shingles(F.col("_text"), n)).otherwise(none) for n in sorted(sizes)]))
    filed = unfold(rows, [*on, "_t1", "_t2"], grams, "_gram").filter(_maybe(_bitmap(keyed, key, bits), key, bits))
    salt = F.pmod(F.col("_t2"), F.lit(splits)).cast("int")
    filed = filed.withColumn("_salt", salt).repartition(*on, "_gram", "_salt")
    counts = filed.groupBy(*on, "_gram", "_salt").agg(F.count(F.lit(1)).alias("_n")).groupBy(*on, "_gram").agg(F.sum("_n").alias("_n"))
    # A needle with an n-gram that no text holds is in none.
    best = keyed.join(counts, [*on, "_gram"], "left").groupBy(*on, "_needle").agg(
        F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count_if(F.col("_n").isNull()).alias("_lost")).filter("_lost = 0").drop("_lost")
    spread = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    candidates = filed.join(spread, [*on, "_gram", "_salt"]).select("_t1", "_t2", "_needle").distinct()
    whole = texts.withColumns({"_t1": F.xxhash64(*texts.columns), "_t2": F.xxhash64(F.lit(1), *texts.columns)})
    pairs = whole.join(candidates, ["_t1", "_t2"]).filter(F.contains(F.col(text), F.col("_needle"))).drop("_t1", "_t2").withColumnRenamed("_needle", needle)
    return pairs if set(wanted.columns) == {*on, needle} else pairs.join(wanted, [*on, needle])


def counted_pairs(needles: DataFrame, texts: DataFrame, needle: str, text: str, on: list[str] = ()) -> DataFrame:
    """``substring_pairs`` after a count of the needles: up to ``NEEDLE_LIST`` of a key are looked for one by one inside each text, which is
    read once and never taken apart; more than that take the inverted index."""
    on = list(on)
    wanted = stable(needles.filter(F.length(needle) > 0))
    distinct = wanted.select(*on, F.col(needle).alias("_needle")).distinct()
    longest, rows, keys = list_sizes(distinct, on)
    if longest > NEEDLE_LIST:
        return substring_pairs(wanted, texts, needle, text, on)
    pairs = _listed_pairs(distinct, texts, needle, text, on, rows, keys)
    return pairs if set(wanted.columns) == {*on, needle} else pairs.join(wanted, [*on, needle])
