"""Text expressions: Column in, Column out. Everything is built in; nothing calls Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word for "none" in condition texts, and codes that mean "skip".
NONE_WORD = "없음"
SKIP_CODES = ("", "-", "없음")
#: How a text names an image, in the order in which they are tried.
IMAGE_PATHS = (r"(?:image_path|path|경로)\s*[:=]\s*([^\s,]+)", r"(?:image|img)\s*[:=]\s*([^\s,]+)", r"([^\s]+\.(?:jpg|jpeg|png|webp|bmp|gif))")


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Null as empty, line ends unified, at most one blank line in a row, ends stripped."""
    unified = F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(unified, "\n{3,}", "\n\n"))


def slug(c: Column, cap: int = 120) -> Column:
    """White space as underscores, only word characters, dots and dashes, capped; empty becomes EMPTY."""
    joined = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\s+", "_")
    kept = F.substring(F.regexp_replace(joined, r"[^0-9A-Za-z가-힣_.\-]", ""), 1, cap)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("EMPTY"))


def surrogate_key(*parts: Column | str) -> Column:
    return F.concat_ws("::", *parts)


def or_default(c: Column, default: str = NONE_WORD) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def template(**fields: Column) -> Column:
    """``name: value`` lines with a default word for empty values."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), or_default(v)) for k, v in fields.items()))


def join_conditions(*conditions: Column, sep: str = " | ") -> Column:
    """The conditions that say something, joined."""
    return F.array_join(F.filter(F.array(*conditions), lambda x: x.isNotNull() & ~strip(x).isin("", NONE_WORD)), sep)


def pad_id(c: Column, width: int = 4) -> Column:
    """Zero-padded on the left; longer ids stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def swap_extension(path: Column, ext: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", ext)


def token(name: Column, k: int, sep: str = "_") -> Column:
    """The k-th token of a name, from 1, or from the end if negative; null beyond."""
    return F.try_element_at(F.split(name, sep), F.lit(k))


def regex_or_null(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null (never an empty string for no match)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def content_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by two bars."""
    return F.sha2(F.concat_ws("||", *parts).cast("binary"), 256)


def hash_text(c: Column, cap: int = 8000) -> Column:
    """Text as it is hashed: stripped, capped, one blank if nothing is left."""
    return F.coalesce(F.nullif(F.substring(strip(F.coalesce(c, F.lit(""))), 1, cap), F.lit("")), F.lit(" "))


def author_line(authors: Column, first: int = 3) -> Column:
    """``authors: array<struct<last, initials>>`` as "Last Init, ..", with "et al." beyond the first few."""
    named = F.transform(F.filter(authors, lambda a: F.coalesce(a["last"], F.lit("")) != ""), lambda a: strip(F.concat_ws(" ", a["last"], a["initials"])))
    return F.concat(F.array_join(F.slice(named, 1, first), ", "), F.when(F.size(named) > first, F.lit(", et al.")).otherwise(F.lit("")))


def preferred(types: Column, order: list[str]) -> Column:
    """The first wanted element that is present, else the first element, else null."""
    wanted = F.array_intersect(F.array(*map(F.lit, order)), types)
    return F.coalesce(F.try_element_at(wanted, F.lit(1)), F.try_element_at(types, F.lit(1)))


def year_of(c: Column) -> Column:
    """First four digits of a free-text date."""
    return F.substring(F.regexp_replace(c, r"\D", ""), 1, 4).try_cast("int")


def boolean_query(core: Column, extra: Column, topics: Column, level: Column) -> Column:
    """A search expression, relaxed from ``strict`` over ``broad`` to ``broadest``."""
    core, extra = F.coalesce(core, F.lit("")), F.coalesce(extra, F.lit(""))
    clause = F.array_join(F.transform(topics, lambda t: F.concat(F.lit('"'), t, F.lit('"[MeSH Terms]'))), " OR ")
    base = (
        F.when((core != "") & (extra != ""), F.concat(F.lit("(("), core, F.lit(") OR ("), extra, F.lit("))")))
        .when(core != "", F.concat(F.lit("("), core, F.lit(")")))
        .when(extra != "", F.concat(F.lit("("), extra, F.lit(")")))
        .otherwise(F.lit(""))
    )
    topical = F.when(base == "", F.concat(F.lit("("), clause, F.lit(")"))).otherwise(F.concat(F.lit("("), base, F.lit(" AND ("), clause, F.lit("))")))
    narrowed = F.when((F.coalesce(F.size(topics), F.lit(0)) > 0) & (level != "broadest"), topical).otherwise(base)
    # The publication types of a strict query.
    types = ["Randomized Controlled Trial", "Meta-Analysis", "Systematic Review", "Clinical Trial"]
    strict = "(" + " OR ".join(f"{t}[Publication Type]" for t in types) + ")"
    parts = F.array(F.nullif(narrowed, F.lit("")), F.lit("Humans[MeSH Terms]"), F.when(level == "strict", F.lit(strict)))
    return F.when(level == "broadest", F.coalesce(F.nullif(narrowed, F.lit("")), core)).otherwise(F.array_join(F.array_compact(parts), " AND "))


def json_block(c: Column, fenced_first: bool = False) -> Column:
    """The JSON array, else object, inside noisy text; null if there is none."""
    fence = regex_or_null(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.coalesce(fence, c)
    found = F.coalesce(regex_or_null(body, r"(?s)\[.*\]"), regex_or_null(body, r"(?s)\{.*\}"))
    return F.coalesce(fence, found) if fenced_first else found


def image_path(c: Column) -> Column:
    """A path given as ``path=..`` or ``image: ..``, else a bare image file name; without quotes around it."""
    found = F.coalesce(*(regex_or_null(c, f"(?i){p}", 1) for p in IMAGE_PATHS))
    return F.btrim(found, F.lit("'\""))


def gender_word(c: Column) -> Column:
    """Female words are tested before male ones, as whole words in any script."""
    low = F.lower(c)
    return F.when(low.rlike(r"(?U)\b(여자|female|woman)\b"), F.lit("female")).when(low.rlike(r"(?U)\b(남자|male|man)\b"), F.lit("male"))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def is_subsequence(needle: Column, haystack: Column) -> Column:
    """Whether the needle's elements appear in the haystack in order."""
    step = F.aggregate(haystack, F.lit(0), lambda i, h: F.when(F.try_element_at(needle, i + 1) == h, i + 1).otherwise(i))
    return step == F.size(needle)


def is_submap(wanted: Column, got: Column) -> Column:
    return F.forall(F.map_entries(wanted), lambda e: F.try_element_at(got, e["key"]).eqNullSafe(e["value"]))


def contains_any(c: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(c, w))


def ellipsis(c: Column, n: int) -> Column:
    """Cut to n characters with dots; line ends become blanks."""
    flat = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def trimmed_lines(c: Column, sep: str = " / ") -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), sep)


def args_text(m: Column) -> Column:
    """A map as ``k='v', ..`` by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'"))), ", ")


def byte_literal(c: Column) -> Column:
    """``b'..'`` as plain text."""
    return F.regexp_replace(c, r"^b'(.*)'$", "$1")


def named_blocks(c: Column) -> Column:
    """``;``-separated ``name: description`` pairs; blanks and pairs without a colon are skipped."""
    pairs = F.transform(F.split(c, ";"), lambda b: F.split(strip(b), ":", 2))
    kept = F.filter(pairs, lambda p: (F.size(p) == 2) & (strip(p[0]) != ""))
    return F.transform(kept, lambda p: F.struct(strip(p[0]).alias("name"), strip(p[1]).alias("description")))


def key_values(default: str, **fields: Column) -> Column:
    """``k=v`` for every value that is not null, else the default."""
    told = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()))
    return F.coalesce(F.nullif(told, F.lit("")), F.lit(default))


def view_of(name: Column) -> Column:
    """Which view a file name tells, null if none."""
    return F.when(F.contains(name, F.lit("_-45_")), F.lit("left")).when(F.contains(name, F.lit("_45_")), F.lit("right")).when(F.contains(name, F.lit("_0_")), F.lit("front"))


def block_text(content: Column) -> Column:
    """Text of a JSON string, of a list of text blocks, or of plain text; null as empty."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return F.when(content.isNull(), F.lit("")).when(content.startswith("["), F.coalesce(listed, content)).otherwise(content)


def _by_score(items: Column) -> Column:
    return F.array_sort(F.transform(items, lambda i: F.struct(i["score"].alias("score"), i["name"].alias("name"))))


def worst_names(items: Column, k: int = 3) -> Column:
    """Names of the k lowest scores of ``array<struct<name, score>>``, then by name."""
    return F.transform(F.slice(_by_score(items), 1, k), lambda i: i["name"])


def scored(name: Column, score: Column) -> Column:
    """A scored item as text."""
    return F.concat(name, F.lit(" "), F.format_string("%.1f", score))


def scored_line(items: Column) -> Column:
    """``array<struct<name, score>>`` as one line, lowest score first, then name."""
    return F.array_join(F.transform(_by_score(items), lambda i: scored(i["name"], i["score"])), ", ")
