"""Drawing registry: pairing by similar names, page rows, routing to chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceframe import config
from traceframe.functions.text import file_name, file_stem, normalized_stem, safe_int
from traceframe.operators.keyed import salted_lookup, top_n


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _letters(stem: Column) -> Column:
    """A stem's characters, each with its occurrence number."""
    chars = F.regexp_extract_all(stem, F.lit("(?s)."), F.lit(0))
    numbered = F.flatten(F.transform(F.array_distinct(chars), lambda c: F.transform(
        F.sequence(F.lit(1), F.size(F.filter(chars, lambda x: x == c))), lambda n: F.concat(c, n.cast("string")))))
    return F.when(stem == "", F.array(F.lit(""))).otherwise(numbered)


def candidate_stems(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """project, ls, rs: distinct stems that may reach the threshold.

    Stems with an edit ratio of at least t share at least t times the longer one's characters. In the order of their counted frequency in
    the project, two such stems have at least two characters in common among their rarest ones (one more than the share leaves
    out), so they meet in an equi-join on pairs of rare characters; stems so short that one common character may do are filed under
    single ones, too. Frequent characters file next to nothing. What meets is counted on all characters before the pair is made."""
    need = F.ceil(F.length("stem") * (threshold - 1e-9))
    side = lambda df: df.select("project", "stem").distinct().select("project", "stem", F.explode(_letters(F.col("stem"))).alias("token"))
    a, b = side(left), side(right)
    counts = a.unionByName(b).groupBy("project", "token").agg(F.count(F.lit(1)).alias("n"))

    def filed(df, name):
        ordered = df.join(counts, ["project", "token"]).groupBy("project", "stem").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
        rare = ordered.withColumn("all", F.col("t")["token"]).withColumn("t", F.slice(F.col("t")["token"], F.lit(1), F.greatest(F.length("stem") - need + 2, F.lit(1)).cast("int")))
        pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.concat(x, F.lit(" "), y))))
        keys = F.when(need <= 1, F.concat(F.col("t"), pairs)).otherwise(pairs)
        return rare.select("project", F.explode(keys).alias("key"), F.col("stem").alias(name), F.col("all").alias(f"{name}_all"))

    low, high = F.least(F.length("ls"), F.length("rs")), F.greatest(F.length("ls"), F.length("rs"))
    least = F.ceil(high * (threshold - 1e-9))
    shared = F.size(F.array_intersect("ls_all", "rs_all"))
    met = filed(a, "ls").join(filed(b, "rs"), ["project", "key"]).filter((low >= least) & (shared >= least))
    return met.select("project", "ls", "rs").distinct()


def stem_matches(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Best right stem for each distinct left stem of a project, at or above ``threshold``, first on ties. Pairs are scored once per
    distinct stem, not per file."""
    score = edit_ratio(F.col("ls"), F.col("rs"))
    good = candidate_stems(left, right, threshold).withColumn("score", score).filter(F.col("score") >= threshold)
    first = right.groupBy("project", F.col("stem").alias("rs")).agg(F.min("ord").alias("rord"))
    return good.join(first, ["project", "rs"]).groupBy("project", "ls").agg(
        F.max_by(F.struct("rs", "rord", "score"), F.struct("score", -F.col("rord"))).alias("b")
    ).select("project", F.col("ls").alias("stem"), "b.rord", "b.score")


def pair_files(left: DataFrame, right: DataFrame, threshold: float = 0.55):
    """Pair every left file with its most similar right file of the project by edit distance (first on ties);
    ``project, ord, name, path`` with ``ord`` unique in the project. A right file may serve
    several. Returns the registry (pairs, gaps, leftover rights) and review rows for gaps."""
    ls, rs = left.withColumn("stem", normalized_stem("name")), right.withColumn("stem", normalized_stem("name"))
    best = stem_matches(ls, rs, threshold)
    matched = salted_lookup(ls, best, ["project", "stem"], by=["ord", "path"])
    chosen = right.select("project", F.col("ord").alias("rord"), F.col("name").alias("pdf_name"), F.col("path").alias("pdf_path"))
    pairs = matched.join(chosen, ["project", "rord"], "left").select(
        "project", F.lit("dwg").alias("side"), "ord", F.col("path").alias("dwg_path"), F.col("name").alias("dwg_name"),
        F.coalesce("pdf_path", F.lit("")).alias("pdf_path"), F.coalesce("pdf_name", F.lit("")).alias("pdf_name"),
        F.bround(F.coalesce("score", F.lit(0.0)), 3).alias("match_score"),
        file_stem(F.coalesce("pdf_name", "name")).alias("title"),
        F.when(F.col("pdf_path").isNull(), "missing_pdf").otherwise("pending_analysis").alias("status"))
    used = best.join(ls.select("project", "stem").distinct(), ["project", "stem"], "left_semi").select(
        "project", F.col("rord").alias("ord")).distinct()
    rest = right.join(used, ["project", "ord"], "left_anti").select(
        "project", F.lit("pdf").alias("side"), "ord", F.lit("").alias("dwg_path"), F.lit("").alias("dwg_name"),
        F.col("path").alias("pdf_path"), F.col("name").alias("pdf_name"), F.lit(0.0).alias("match_score"),
        file_stem("name").alias("title"), F.lit("pending_analysis").alias("status"))
    registry = pairs.unionByName(rest)
    review = pairs.filter("status = 'missing_pdf'").select(
        "project", F.lit("图纸待转换").alias("category"), F.concat("dwg_name", F.lit(" 尚无对应PDF")).alias("title"),
        F.lit("V1不直接解析DWG。请使用AutoCAD手动导出PDF并上传到本项目。").alias("detail"), F.lit("high").alias("severity"),
        F.lit("open").alias("status"), F.col("dwg_path").alias("source_path"))
    return registry, review


def expand_drawings(registry: DataFrame, jobs: DataFrame, default_confidence: float = 0.75) -> DataFrame:
    """Replace whole-PDF rows that were analysed by page rows: one per detected drawing, or
    one per page image if none was detected.

    registry: ``project, drawing_id, pdf_path, title``; jobs: ``project, pdf_path,
    drawings ARRAY<STRUCT<drawing_no,title,page,confidence>>, images ARRAY<STRING>``."""
    seen = F.size("drawings") > 0
    ran = jobs.filter(seen | (F.size("images") > 0))
    keep = registry.join(ran.select("project", "pdf_path"), ["project", "pdf_path"], "left_anti").select(
        "project", "drawing_id", "pdf_path", F.lit(None).cast("int").alias("source_page"), F.lit("").alias("drawing_no"),
        "title", F.lit(0.0).alias("confidence"), F.lit("").alias("preview"), F.lit("pending_analysis").alias("status"))
    base = top_n(registry.select("project", "pdf_path", "drawing_id"), ["project", "pdf_path"], [F.desc("drawing_id")])
    none = F.transform("images", lambda x, i: F.struct(
        F.lit("").alias("drawing_no"), F.lit("").alias("title"), (i + 1).cast("string").alias("page"),
        F.lit(None).cast("double").alias("confidence")))
    found = F.when(seen, F.col("drawings")).otherwise(none)
    rows = ran.join(base, ["project", "pdf_path"], "left").select(
        "project", "pdf_path", "images", F.coalesce("drawing_id", F.concat(F.lit("pdf-"), F.md5("pdf_path"))).alias("base"),
        F.posexplode(found).alias("_i", "d"))
    stem = file_stem("pdf_path")
    page = F.coalesce(F.nullif(safe_int("d.page"), F.lit(0)), F.col("_i") + 1).cast("int")
    rows = rows.withColumn("source_page", page)
    number = F.col("source_page").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    title = F.coalesce(F.nullif(F.trim("d.title"), F.lit("")), stem)
    named = F.get(F.filter("images", lambda x: file_name(x).contains(F.concat(F.lit("page-"), padded)) &
                           ~file_name(x).contains("tile-")), F.lit(0))
    at = F.when(F.col("source_page") <= F.size("images"), F.get("images", F.col("source_page") - 1))
    pages = rows.select(
        "project", F.concat("base", F.lit("-p"), padded).alias("drawing_id"), "pdf_path", "source_page",
        F.coalesce(F.trim("d.drawing_no"), F.lit("")).alias("drawing_no"), title.alias("title"),
        F.coalesce(F.nullif("d.confidence", F.lit(0.0)), F.lit(default_confidence)).alias("confidence"),
        F.coalesce(named, at, F.lit("")).alias("preview"), F.lit("pending_confirmation").alias("status"), "_i")
    unique = top_n(pages, ["project", "pdf_path", "source_page", "drawing_no"], ["_i"]).drop("_i")
    return keep.unionByName(unique)


def route_drawings(drawings: DataFrame, sections: DataFrame, fallback: str = "04", caption: str = "设计图纸引用") -> DataFrame:
    """Chapter of every confirmed drawing: a two-digit target is a code, any other target
    the first chapter whose title contains it, else the fallback.

    ``sections`` (``project, code, ord, title``) is a project's short chapter list."""
    use = drawings.filter((F.col("status") == "confirmed") & (F.coalesce("pdf_path", F.lit("")) != ""))
    targets = F.when(F.size("applicable_sections") > 0, F.col("applicable_sections")).otherwise(F.array(F.lit(fallback)))
    rows = use.withColumn("target", F.explode(targets))
    lists = sections.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("ord", "code", "title"))).alias("_s"))
    hit = F.get(F.filter("_s", lambda s: F.contains(s["title"], F.col("target"))), F.lit(0))["code"]
    code = F.when(F.col("target").rlike(r"^\d{2}$"), F.col("target")).otherwise(F.coalesce(hit, F.lit(fallback)))
    text = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("caption", "title", "drawing_no")], F.lit(caption))
    mark = F.when(F.col("placement") == "landscape_page", "|landscape").otherwise("")
    return salted_lookup(rows, lists, ["project"], by=["drawing_id", "target"]).select(
        "project", "drawing_id", code.alias("section_code"), F.concat(text, mark).alias("caption"), "pdf_path")


def patch_drawings(drawings: DataFrame, updates: DataFrame) -> DataFrame:
    """Supplied fields replace the stored ones; a confirmation is stamped."""
    fields = [c for c in updates.columns if c not in ("project", "drawing_id")]
    one = updates.groupBy("project", "drawing_id").agg(F.max(F.struct(*fields)).alias("_u"))  # of repeated updates the greatest counts
    u = one.select("project", "drawing_id", *[F.col(f"_u.{c}").alias(f"_{c}") for c in fields])
    out = drawings.join(u, ["project", "drawing_id"], "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    if "status" in fields:
        out = out.withColumn("confirmed_at", F.when(F.col("_status") == "confirmed", F.current_timestamp()).otherwise(
            F.col("confirmed_at")))
    return out.drop(*[f"_{c}" for c in fields])
