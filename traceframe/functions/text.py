"""Column functions for text, numbers and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from traceframe import config
from traceframe.functions.patterns import ODD_SPACE, wide

# COLLAPSE matches only what has to change, not single blanks.
SPACE = f"[ {ODD_SPACE}]+"
COLLAPSE = f"[{ODD_SPACE}][ {ODD_SPACE}]*| [ {ODD_SPACE}]+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


ASCII_DIGITS = ("０１２３４５６７８９", "0123456789")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values) -> Column:
    """A literal ARRAY<STRING>; also right for an empty list."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(col(c), COLLAPSE, " "))


def remove_space(c) -> Column:
    return F.regexp_replace(col(c), SPACE, "")


def compact_text(c, limit: int | None = None) -> Column:
    """Collapse whitespace; with ``limit`` cut to so many characters with an ellipsis."""
    if limit is None:
        return collapse(c)
    return let(
        collapse(c),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))
        ),
    )


def split_lines(c) -> Column:
    """Lines of a text; a final line break does not start another line."""
    c = col(c)
    return let(
        F.split(c, LINE_BREAK, -1),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def contains_any(c, words) -> Column:
    c = col(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def casefold(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "ß", "ss"), "ς", "σ")


def safe_int(c, mode: str = "strict") -> Column:
    """``strict``: the whole value is an integer; ``first``: first run of digits. Full-width digits count, too."""
    text = F.translate(col(c).cast("string"), *ASCII_DIGITS)
    if mode == "first":
        text = F.regexp_extract(text, r"\d+", 0)
    return F.trim(text).try_cast("bigint")


def lookup(c, mapping: dict[str, str], default=None) -> Column:
    """Value of a small fixed mapping, as a CASE chain."""
    c = col(c)
    otherwise = c if default is None else (default if isinstance(default, Column) else F.lit(default))
    if not mapping:
        return otherwise
    items = list(mapping.items())
    out = F.when(c == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        out = out.when(c == key, F.lit(value))
    return out.otherwise(otherwise)


def canonical_title(c, aliases: dict[str, str] = config.SECTION_ALIASES) -> Column:
    return lookup(c, aliases)


def clean_title(c, limit: int | None = None) -> Column:
    """Drop a leading chapter mark or number."""
    pattern = wide(r"^\s*(?:第[一二三四五六七八九十百0-9]+章|[0-9]+(?:\.[0-9]+)*[、.．]?)\s*")
    title = F.trim(F.regexp_replace(col(c), pattern, ""))
    return title if limit is None else F.substring(title, 1, limit)


def strip_heading_number(c) -> Column:
    """First of three numbering forms whose removal changes the title and leaves text."""
    text = F.trim(col(c))
    forms = [
        wide(r"^第[一二三四五六七八九十百\d]+[章节][、\s：:.-]*"),
        wide(r"^[一二三四五六七八九十百]+[、.．]\s*"),
        wide(r"^\d+(?:\.\d+)*(?:[.)、．]|\s+)"),
    ]
    tries = []
    for form in forms:
        stripped = F.trim(F.regexp_replace(text, form, ""))
        tries.append(F.when((stripped != text) & (stripped != ""), stripped))
    return F.coalesce(*tries, text)


def ordered_distinct(c, item_len: int | None = None, limit: int | None = None) -> Column:
    """Trimmed, non-empty, first-seen distinct items, cut to length and number."""
    out = F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x != "")
    out = F.array_distinct(out)
    if item_len is not None:
        out = F.transform(out, lambda x: F.substring(x, 1, item_len))
    return out if limit is None else F.slice(out, 1, limit)


def heading_level(c) -> Column:
    c = col(c)
    number = F.regexp_extract(c, wide(r"^\s*(\d+(?:[.．]\d+)*)"), 1)
    return (
        F.when(c.startswith("第"), 1)
        .when(number != "", F.least(F.size(F.split(number, "[.．]")), F.lit(4)))
        .when(c.rlike(wide(r"^\s*[一二三四五六七八九十]+[、.．]")), 1)
        .otherwise(2)
    )


def chinese_number(c) -> Column:
    """Numerals for 1..99, digits otherwise."""
    n = col(c).cast("int")
    digits = F.lit("零一二三四五六七八九")
    digit = lambda d: F.substring(digits, d + 1, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), n % 10
    tail = F.when(ones == 0, "").otherwise(digit(ones))
    return (
        F.when((n <= 0) | (n > 99), n.cast("string"))
        .when(n < 10, digit(n))
        .when(n < 20, F.concat(F.lit("十"), tail))
        .otherwise(F.concat(digit(tens), F.lit("十"), tail))
    )


def file_name(c) -> Column:
    return F.regexp_extract(col(c), r"[^/\\]*$", 0)


def file_stem(c) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]+$", "")


def file_suffix(c) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"(?<=.)\.[^.]+$", 0))


def normalized_stem(c, noise: str = config.DRAWING_NAME_NOISE) -> Column:
    stem = F.regexp_replace(F.lower(file_stem(c)), noise, "")
    return F.regexp_replace(stem, r"[^0-9a-z一-鿿]+", "")


def mask_parameters(c, pattern: str = config.CASE_PARAMETER, mask: str = config.CASE_PARAMETER_MASK) -> Column:
    return F.regexp_replace(col(c), pattern, mask)


def official_source(code, sources=config.OFFICIAL_SOURCES) -> Column:
    """Platform and address that publish a standard, by code prefix."""
    key = F.regexp_replace(F.upper(col(code)), " ", "")
    entry = lambda s: F.struct(F.lit(s[1]).alias("platform"), F.lit(s[2]).alias("url"))
    out = F.when(key.startswith(sources[0][0]), entry(sources[0]))
    for source in sources[1:-1]:
        out = out.when(key.startswith(source[0]), entry(source))
    return out.otherwise(entry(sources[-1]))


def host_allowed(url, hosts=config.OFFICIAL_HOSTS) -> Column:
    """The address' host is an allowed host or lies under one."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    allowed = F.lit(False)
    for suffix in hosts:
        allowed = allowed | (host == suffix) | host.endswith("." + suffix)
    return F.coalesce(allowed, F.lit(False))


def component_kind(title, kinds=config.COMPONENT_KINDS, default: str = "text") -> Column:
    title = col(title)
    out = None
    for words, kind in kinds:
        hit = F.lit(True)
        for word in words:
            hit = hit & title.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def find_all(text, pattern: str, groups: int = 0, starts: bool = True) -> Column:
    """All matches of a pattern with their 0-based start, which is left out without ``starts``:
    ARRAY<STRUCT<start INT, full STRING, g1 STRING, ...>>."""
    text = col(text)
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def located(full):
        if not starts:
            def plain(p):
                return F.transform(full, lambda m, i: F.struct(m.alias("full"), *[F.get(p[f"g{g}"], i).alias(f"g{g}") for g in range(1, groups + 1)]))

            found = F.struct(F.lit(0).alias("n"), *[all_of(g).alias(f"g{g}") for g in range(1, groups + 1)])
            return F.when(F.size(full) > 0, let(found, plain)).otherwise(F.when(full.isNotNull(), none))
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        parts = F.struct(
            gaps.alias("gaps"),
            *[all_of(g).alias(f"g{g}") for g in range(1, groups + 1)],
        )

        def rows(p):
            before = lambda i: F.aggregate(
                F.slice(full, 1, i), F.lit(0), lambda a, m: a + F.length(m)
            ) + F.aggregate(F.slice(p["gaps"], 1, i + 1), F.lit(0), lambda a, g: a + g)
            return F.transform(
                full,
                lambda m, i: F.struct(
                    before(i).alias("start"),
                    m.alias("full"),
                    *[F.get(p[f"g{g}"], i).alias(f"g{g}") for g in range(1, groups + 1)],
                ),
            )

        return F.when(F.size(full) > 0, let(parts, rows)).otherwise(F.when(full.isNotNull(), none))

    kind = ", ".join([*["start: int"] * starts, "full: string", *[f"g{g}: string" for g in range(1, groups + 1)]])
    none = F.array().cast(f"array<struct<{kind}>>")
    return let(all_of(0), located)


def match_excerpt(text, start: Column, end: Column, before: int = 80, after: int = 140, limit: int = 320) -> Column:
    begin = F.greatest(start - before, F.lit(0))
    return compact_text(F.substring(col(text), begin + 1, end + after - begin), limit)


def parse_json_answer(c, schema: str) -> Column:
    """Parse a JSON answer; failing that, the outermost braces inside it.
    STRUCT<value, parse_status> with status ok, extracted or error."""
    c = col(c)
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    valid = lambda t: F.try_parse_json(t).isNotNull()
    return (
        F.when(valid(c), F.struct(F.from_json(c, schema).alias("value"), F.lit("ok").alias("parse_status")))
        .when(
            (inner != "") & valid(inner),
            F.struct(F.from_json(inner, schema).alias("value"), F.lit("extracted").alias("parse_status")),
        )
        .otherwise(
            F.struct(F.from_json(F.lit(None).cast("string"), schema).alias("value"), F.lit("error").alias("parse_status"))
        )
    )
