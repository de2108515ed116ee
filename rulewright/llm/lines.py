"""Fuzzy duplicate lines, with DataFrame expressions only.

A line is compared trimmed and in lower case. Its shingles are the runs of
``WIDTH`` characters that start at every character; a shorter line is one
shingle. Equal lines collapse first and are signed once.

Signatures are one-permutation MinHash. A hash deals each shingle into one of
``BINS`` bins, and the minimum and the maximum of each bin are two signature
values. A line with few shingles would leave bins empty, so it is dealt again in
rounds with fresh hashes until it has made ``FILL`` throws; an earlier round
beats a later one, so that lines of different length agree on the rounds they
share. Bands hold ``ROWS`` values, 28 bands for a line, and 56 from two
signatures for one of fewer than ``SHORT`` shingles, whose minima and maxima
often come from the same shingle. A pair of similarity exactly 0.8 is missed with
probability of about 2e-4, and up to 1e-3 if the sizes are 80 and 100 (measured
in the tests). One bit of each value is kept as a sketch; pairs whose sketches
differ by ``DEVIATIONS`` standard deviations more than those of a pair at the
threshold are told apart by it.

Members of a band bucket are verified against the bucket's first line by exact
Jaccard similarity and united: each line against one such line, then against
the others that are still in a different component. Buckets that still hold
several components are opened again and all pairs of different components
are verified inside groups of bounded size, each pair in one of the buckets
that hold both lines; only the pairs of components that link come out. One line of each component stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.components import connected_components
from rulewright.llm.names import fresh
from rulewright.storage import Workspace

WIDTH = 5
ROWS = 6
GROUPS = 14
BINS = ROWS * GROUPS
FILL = 3 * BINS
SHORT = 64
#: Groups of bins whose rows carry the line's keys; none of FILL throws falls into them with probability of 4e-27.
NAMED = 3
#: Standard deviations by which the sketches of two lines may differ more than expected at the threshold (a miss of about 1e-9).
DEVIATIONS = 7
#: Lines of an opened bucket that meet in one group; larger buckets are cut into blocks that meet in pairs.
BLOCK_ROWS = 128
#: Parts of the band keys that are shuffled one after the other.
SLICES = 4
#: Tables up to this many bytes, as counted, are broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20

_LOW = (1 << 40) - 1


def _shingles(line: Column) -> Column:
    """The distinct shingle hashes of a line."""
    chars = F.encode(line, "UTF-32")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(line) - WIDTH))
    # The array of one text binds its characters, so that they are made once.
    made = F.transform(F.array(chars), lambda c: F.transform(starts, lambda i: F.xxhash64(F.substring(c, 4 * i + 1, F.lit(4 * WIDTH)))))
    return F.array_distinct(F.flatten(made))


def _lines(docs: DataFrame, *kept: str) -> DataFrame:
    """``pos``, the compared line ``said`` and its keys ``k1, k2``, for lines that are not blank."""
    lines = docs.select(*kept, F.posexplode(F.split("text", "\n")).alias("pos", "said"))
    # Blank lines are told before the lower case is made, which would else be made twice.
    lines = lines.select(*kept, "pos", F.btrim("said", F.lit(" \t\r")).alias("said")).where("said != ''").withColumn("said", F.lower("said"))
    return lines.select("*", F.xxhash64("said").alias("k1"), F.xxhash64("said", F.lit(17)).alias("k2"))


def _signed_lines(docs: DataFrame) -> DataFrame:
    """``line, k1, k2, copies, at, low, high, low_bits, high_bits``: each distinct line's bands, by groups of bins.

    Everything after the collapse is keyed by the line, so it runs where the line is. ``k1, k2, copies`` stand in some of a line's rows only.
    """
    one = _lines(docs).groupBy("k1", "k2").agg(F.first("said").alias("said"), F.count("*").alias("copies"))
    one = one.select(F.monotonically_increasing_id().alias("line"), "k1", "k2", "copies", F.encode("said", "UTF-32").alias("chars"))
    one = one.withColumn("n", F.expr(f"greatest(1, cast(octet_length(chars) div 4 as int) - {WIDTH - 1})"))
    # The throws of a round are its shingles; a short line makes all rounds twice.
    one = one.withColumn("rounds", F.expr(f"cast(({FILL} + n - 1) div n as int)"))
    throws = one.select("line", "k1", "k2", "copies", "chars", "n", "rounds", F.explode(F.expr(f"sequence(0, if(n < {SHORT}, 2, 1) * n * rounds - 1)")).alias("throw"))
    throws = throws.select("line", "k1", "k2", "copies", "rounds", F.expr("cast(throw div n as int)").alias("r"), F.expr(f"substring(chars, 4 * (throw % n) + 1, {4 * WIDTH})").alias("gram"))
    # A second signature starts again at round 0, with other hashes.
    fresh = throws.select("line", "k1", "k2", "copies", F.expr("if(r < rounds, 0, 1)").alias("again"), F.expr("if(r < rounds, r, r - rounds)").alias("round"), "gram")
    dealt = fresh.select("line", "k1", "k2", "copies", "again", "round", F.xxhash64(F.expr("65536 * again + round"), "gram").alias("h"))
    value = f"shiftleft(cast(round as long), 40) | (h & {_LOW}L)"
    dealt = dealt.select("line", "k1", "k2", "copies", "again", F.expr(f"cast(shiftrightunsigned(h, 40) % {BINS} as int)").alias("bin"), F.expr(value).alias("lo"))
    dealt = dealt.select("line", "k1", "k2", "copies", F.expr(f"cast({GROUPS} * again + bin div {ROWS} as int)").alias("at"), F.expr(f"bin % {ROWS}").alias("i"), "lo", F.expr(f"lo ^ {_LOW}L").alias("hi"))
    ends = [F.expr(f"min(if(i = {i}, {x}, null))").alias(f"{x}{i}") for x in ("lo", "hi") for i in range(ROWS)]
    signed = dealt.groupBy("line", "k1", "k2", "copies", "at").agg(*ends)
    band = {x: F.xxhash64("at", F.lit(x), *(F.col(f"{x}{i}") for i in range(ROWS))) for x in ("lo", "hi")}
    bits = {x: F.expr(" | ".join(f"shiftleft(cast(coalesce({x}{i}, 0) & 1 as int), {i})" for i in range(ROWS))) for x in ("lo", "hi")}
    # A line has throws in the first groups of bins; its keys stand in their rows only.
    keys = [F.expr(f"if(at < {NAMED}, {c}, null)").alias(c) for c in ("k1", "k2", "copies")]
    return signed.select("line", *keys, "at", band["lo"].alias("low"), band["hi"].alias("high"), bits["lo"].alias("low_bits"), bits["hi"].alias("high_bits"))


def _sketches(signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys and sketch of the wanted lines, two longs and two more: 84 bits of minima and 84 of maxima."""
    half = GROUPS // 2
    own = signed.where(f"at < {GROUPS}").join(wanted, "line", "left_semi")
    parts = [
        F.sum(F.expr(f"if(at >= {a} and at < {a + half}, shiftleft(cast({x}_bits as long), {ROWS} * (at - {a})), 0L)")).alias(f"{x}_{a}") for x in ("low", "high") for a in (0, half)
    ]
    return own.groupBy("line").agg(F.max("k1").alias("k1"), F.max("k2").alias("k2"), *parts)


SKETCH = [f"{x}_{a}" for x in ("low", "high") for a in (0, GROUPS // 2)]


def _close(x: str, y: str, percent: int) -> str:
    """Whether the sketches allow the similarity, as a condition on two rows or structs."""
    differ = (100 - percent) / 200
    most = 2 * BINS * differ + DEVIATIONS * (2 * BINS * differ * (1 - differ)) ** 0.5
    return " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in SKETCH) + f" <= {most}"


def _small(table: DataFrame, width: int, items: str = "1") -> DataFrame:
    """Broadcast a table behind a check of its bytes (``width`` for a row or item); else leave it to a shuffle."""
    n = table.agg(F.sum(F.expr(items))).first()[0] or 0
    return F.broadcast(table) if n * width <= BROADCAST_BYTES else table.hint("merge")


def _alike(x: str, y: str, percent: int) -> str:
    """100 * shared >= percent * united, as a condition on two shingle arrays; sizes too far apart are told first."""
    return f"100 * least(size({x}.sh), size({y}.sh)) >= {percent} * greatest(size({x}.sh), size({y}.sh)) and {100 + percent} * size(array_intersect({x}.sh, {y}.sh)) >= {percent} * (size({x}.sh) + size({y}.sh))"


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(pivot, line)`` that link, as ``(a, b)``."""
    said = texts.select("line", "said").hint("merge")
    both = pairs.join(said.withColumnRenamed("said", "said_y"), "line").join(said.withColumnRenamed("line", "pivot"), "pivot")
    # The array of one pair binds both sets, so that each is made once.
    both = both.withColumn("pair", F.array(F.struct(F.struct(_shingles(F.col("said")).alias("sh")).alias("x"), F.struct(_shingles(F.col("said_y")).alias("sh")).alias("y"))))
    return both.where(f"exists(pair, p -> {_alike('p.x', 'p.y', percent)})").select(F.col("pivot").alias("a"), F.col("line").alias("b"))


def _members(signed: DataFrame, ws: Workspace) -> list[str]:
    """Tables of ``key, line, pivot, n``: lines in a bucket with others, its first line and its size.

    The bands are shuffled in ``SLICES`` parts of their keys, one after the other, so that the disk holds a part at a time.
    """
    names = []
    for i in range(SLICES):
        keyed = signed.select("line", F.explode(F.array("low", "high")).alias("key")).where(f"pmod(key, {SLICES}) = {i}")
        shared = ws.save(keyed.groupBy("key").agg(F.min("line").alias("pivot"), F.count("*").alias("n")).where("n > 1"), f"shared-{i}")
        ws.save(keyed.join(_small(shared, 40), "key").select("key", "line", "pivot", "n"), f"members-{i}")
        ws.drop(f"shared-{i}")
        names.append(f"members-{i}")
    return names


def _compared(opened: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``ms, pairs``: blocks of members of opened buckets, and the places of those that are to be verified with each other.

    Two lines are verified if their components differ and their sketches are close, and in the least of the opened buckets that hold both.
    """
    buckets = opened.groupBy("line").agg(F.collect_list("key").alias("keys"))
    own = opened.join(texts.hint("merge"), "line").join(buckets.hint("merge"), "line").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    member = F.struct("part", "block", "keys", *SKETCH, "said").alias("m")
    groups = own.groupBy("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(member).alias("ms"))
    apart = f"y.part > x.part and (low = high or x.block != y.block) and {_close('x', 'y', percent)} and array_min(array_intersect(x.keys, y.keys)) = key"
    places = f"transform(filter(transform(ms, (y, j) -> if({apart}, j, -1)), j -> j >= 0), j -> struct(i as x, j as y))"
    return groups.select("ms", F.expr(f"flatten(transform(ms, (x, i) -> {places}))").alias("pairs"))


def _bucket_links(compared: DataFrame, percent: int) -> DataFrame:
    """The pairs of components ``(a, b)`` that a verified pair of lines links."""
    used = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["x"], p["y"]))))
    # The array of one list binds it, so that it is made once.
    sets = F.flatten(F.transform(F.array(used), lambda u: F.transform("ms", lambda m, i: F.struct(m["part"].alias("part"), F.when(F.array_contains(u, i), _shingles(m["said"])).alias("sh")))))
    # The pairs are exploded, so that their sets are compared by generated code; an inner explode is preceded by a filter that makes the pairs twice.
    each = compared.select("pairs", sets.alias("gs")).select("gs", F.explode_outer("pairs").alias("p"))
    return each.where(_alike("get(gs, p.x)", "get(gs, p.y)", percent)).select(F.expr("get(gs, p.x).part").alias("a"), F.expr("get(gs, p.y).part").alias("b")).distinct()


def _components(docs: DataFrame, signed: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """``(node, component)`` over distinct lines, for lines that link."""
    slices = _members(signed, ws)
    members = signed.sparkSession.read.schema("key long, line long, pivot long, n long").parquet(*map(ws.path, slices))
    sketch = ws.save(_sketches(signed, members.select("line").distinct().hint("merge")), "sketches")
    bits = sketch.select("line", *SKETCH)
    x, y = bits.withColumnRenamed("line", "pivot").alias("x"), bits.alias("y")
    pairs = members.where("line != pivot").select("pivot", "line").distinct().join(y, "line").join(x, "pivot")
    pairs = ws.save(pairs.where(_close("x", "y", percent)).select("pivot", "line"), "pairs")
    # A bucket of two is settled by its pair with the pivot; only larger ones are opened.
    wanted = members.where("n > 2").select("line").union(pairs.select("line")).union(pairs.select("pivot")).distinct()
    wanted = ws.save(sketch.join(wanted.hint("merge"), "line", "left_semi"), "wanted")
    found = _lines(docs).join(_small(wanted.select("line", "k1", "k2"), 48), ["k1", "k2"]).groupBy("line").agg(F.first("said").alias("said"))
    texts = ws.save(found.join(wanted.drop("k1", "k2").hint("merge"), "line"), "texts")

    first = pairs.groupBy("line").agg(F.min("pivot").alias("pivot")).select("pivot", "line")
    links = ws.save(_verified(first, texts, percent), "first-links")
    labels = ws.save(connected_components(links, ws, "first-cc"), "first-labels")
    part = lambda of: labels.select(F.col("node").alias(of), F.col("component").alias(f"{of}_part")).hint("merge")
    rest = pairs.join(first.hint("merge"), ["pivot", "line"], "left_anti").join(part("line"), "line", "left").join(part("pivot"), "pivot", "left")
    rest = rest.where("coalesce(line_part, line) != coalesce(pivot_part, pivot)").select("pivot", "line")
    more = ws.save(_verified(rest, texts, percent), "rest-links")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = ws.save(connected_components(known.unionByName(more), ws, "pair-cc"), "pair-labels")

    marked = members.where("n > 2").join(labels, members["line"] == labels["node"], "left").select("key", "line", F.coalesce("component", "line").alias("part"))
    several = marked.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("blocks")).where("lo != hi")
    opened = ws.save(marked.join(several.select("key", "blocks"), "key"), "opened")
    more = ws.save(_bucket_links(_compared(opened, texts, percent), percent), "bucket-links")
    ws.drop(*slices, "texts", "sketches", "pairs", "wanted", "opened")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return ws.save(connected_components(known.unionByName(more), ws, "all-cc"), "labels")


def drop_repeated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows without their repeated lines, and ``n_lines`` and ``n_removed``.

    Of each component of alike lines the first, by document id and position,
    stays; blank lines always stay, and count in ``n_lines``. A null text stays
    null with no lines. Lines of rows with a null id are never removed. Rows that
    share an id but not their text are documents of their own, of which no line
    is lost for the other's sake; rows equal in id and text are one document, and
    each of them is returned alike. Columns named like the two counts are
    replaced; others stay.
    """
    docs = docs.drop("n_lines", "n_removed")
    ws = Workspace(docs.sparkSession, "lines")
    d1, d2, lost = fresh(docs, "d1", "d2", "gone")
    identity = [F.xxhash64(id_col, text_col), F.xxhash64(F.lit(29), text_col, id_col)]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), identity[0].alias("d1"), identity[1].alias("d2"))
    signed = ws.save(_signed_lines(own), "signed")
    labels = _components(own, signed, ws, percent)
    # A line that occurs once and links with none needs no further look.
    found = signed.where("k1 is not null").select("line", "k1", "k2", "copies").join(labels.hint("merge"), F.col("line") == F.col("node"), "left").where("component is not null or copies > 1")
    found = ws.save(found.select("k1", "k2", F.coalesce("component", "line").alias("part")).distinct(), "found")
    seen = _lines(own, "id", "d1", "d2").join(_small(found, 48), ["k1", "k2"]).select("part", F.struct("id", "d1", "d2", "pos").alias("at"))
    seen = ws.save(seen, "seen")
    ws.drop("signed", "labels", "found")
    kept = ws.save(seen.groupBy("part").agg(F.min("at").alias("keep")), "kept")
    gone = seen.join(_small(kept, 80), "part").where("at != keep and at.id is not null").groupBy(F.col("at.d1").alias("d1"), F.col("at.d2").alias("d2"))
    gone = gone.agg(F.collect_set("at.pos").alias("gone"))
    gone = ws.save(gone, "gone")
    ws.drop("seen", "kept")
    gone = _small(gone, 8, "4 + size(gone)")
    joined = docs.select("*", identity[0].alias(d1), identity[1].alias(d2)).join(gone.toDF(d1, d2, lost), [d1, d2], "left")
    parts, changed = F.split(F.col(text_col), "\n"), F.col(lost).isNotNull()
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    rest = F.array_join(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: p[i]), "\n")), "")
    columns = [F.when(changed, rest).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.when(changed, F.size(lost)).otherwise(F.lit(0)).cast("long").alias("n_removed"))


def drop_repeated_documents(docs: DataFrame) -> DataFrame:
    """Documents without repeated lines, ``n_chars`` counted again; a document that lost all its text goes."""
    counts = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    aside = dict(zip(counts, fresh(docs, *(f"{c}_own" for c in counts)), strict=True))
    out = drop_repeated(docs.withColumnsRenamed(aside))
    out = out.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    out = out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in aside.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))
