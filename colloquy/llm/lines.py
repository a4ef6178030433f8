"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Lines link at ``edits`` or fewer insertions, deletions and substitutions. A line of length ``l`` is split into ``edits + 1``
segments; one of them survives in any line that links. The shorter line of a pair is indexed by its segments, the longer
one probes the substrings that can align with a segment of each length in reach (both of the multi-match bounds hold).
Index and probe rows of all distinct lines are dealt by a hash of (length, segment number, segment) once; only rows that
meet another line there live on, and are paired.

Where more than ``CROWD`` rows meet, as variants of one template do, the lines are split finer instead. A cell says where
the edits may lie: in one interval of the indexed line, or in two with one edit each and the characters between them moved
by a known shift. A cell's key is all that lies outside of its intervals. Intervals are cut into pieces and
every choice of pieces for the edits becomes a cell of its own, until few lines share a key or the intervals have one
character, so that all lines that share a key link. No link is lost, and the pairs stay in proportion to the links.
Pairs are verified by a banded bit-parallel automaton.

The threshold is one number for all lines. Lines under ``least_chars`` characters link to equal ones only: at a distance
of two edits most of them are one another's neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, quoted, scratch
from .components import connected_components

EDITS, LEAST_CHARS = 2, 10
#: Rows that may share a key before the lines are split finer, and the pieces that one interval, or each of two, is cut into.
CROWD, PIECES, HALVES = 16, 4, 2
#: One of so many ids is looked at for keys that a great many rows share; those are not brought together in one task.
LOOK, HOT, MOST_HOT = 64, 500, 2_000
#: Bits of the filter that keeps lines without partners from being moved: a bound on what is broadcast for it.
FILTER_BITS = 24


def _div(a: Column, k: int) -> Column:
    return F.call_function("div", a, F.lit(k)).cast("int")


def _rows(names: str, rows: list[tuple]) -> Column:
    """An array of rows of numbers."""
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names.split(), r, strict=True)]) for r in rows])


def _segment_keys(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """``key, id, d`` of ``lines(id, line, n)``; negative ids are probes that are not indexed, for lines ``d`` shorter."""
    k = edits + 1
    plan = [(0, i, 0) for i in range(1, k + 1)]
    for d in range(k):
        for i in range(1, k + 1):
            low, high = max(1 - i, d - (k - i)), min(i - 1, d + (k - i))
            plan += [(d, i, s) for s in range(low, high + 1) if d or s]
    d, i, s = (F.col(f"at.{c}") for c in "dis")
    length = (F.col("n") - d).cast("int")
    dealt = lines.where(F.col("n") >= least).select("id", "line", "n", F.explode(_rows("d i s", plan)).alias("at")).where(length >= least)
    size, longer = _div(length, k), length % k
    start = size * (i - 1) + F.greatest(F.lit(0), longer + i - (k + 1)) + 1 + s
    part = F.substring("line", start, size + (i > k - longer).cast("int"))
    signed = F.when((d == 0) & (s == 0), F.col("id")).otherwise(-F.col("id"))
    return dealt.select(F.xxhash64(length, i, part).alias("key"), signed.alias("id"), d.alias("d"))


def _trimmed(line: Column) -> Column:
    """Without blanks at both ends; most lines have none, and looking at their ends costs less than a walk."""
    blank = F.lit(False)
    for c in " \t\r":
        blank |= line.startswith(c) | line.endswith(c)
    return F.when(blank, F.btrim(line, F.lit(" \t\r"))).otherwise(line)


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, line_no, line, h``: lines between line breaks, blanks at both ends off; blank lines are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
        .withColumn("line", _trimmed(F.col("raw")))
        .where("line <> ''")
        .select("doc_id", "mark", "line_no", "line", F.xxhash64("line").alias("h"))
    )


def distinct_lines(lines: DataFrame, table: str) -> DataFrame:
    """A row per distinct line: ``id`` (from 1), ``h, line, n, copies``; written once."""
    spark = lines.sparkSession
    found = lines.groupBy("h", "line").agg(F.count("*").alias("copies"))
    path = scratch(spark, table)
    numbered = found.select((F.monotonically_increasing_id() + 1).alias("id"), "h", "line", F.length("line").alias("n"), "copies")
    numbered.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _same_ends(a: Column, b: Column, most: Column) -> Column:
    """Length of the common start, up to ``most``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    longer = lambda p, s: F.when((p + s <= most) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s)), p + s).otherwise(p)
    return F.aggregate(F.filter(steps, lambda s: s <= most), F.lit(0), longer)


def _read(a: Column, b: Column, edits: int, steps: Column) -> Column:
    """The state after ``steps`` characters of ``a``, of arrays of characters ``a`` and ``b``: a banded bit-parallel automaton.

    The state has a lane of ``2 * edits + 1`` bits for each number of edits up to ``edits``, a bit for each diagonal of the
    band; it is set if the characters read so far can end on that diagonal with so many edits. A character's step matches
    (and), substitutes (next lane), deletes (next lane, one bit down) and inserts (next lane, one bit up) in all lanes and
    diagonals at once. A state of 0 stays.
    """
    width = 2 * edits + 1
    lanes = edits + 1
    every = sum(1 << width * e for e in range(lanes))
    whole = (1 << width * lanes) - 1
    not_low, not_high = whole & ~every, whole & ~(every << (width - 1))  # bits that can move down, or up, within their lane
    bits = lambda n: F.lit(n).cast("long")

    def closed(r: Column) -> Column:
        for _ in range(edits):  # insertions move up without reading
            r = r.bitwiseOR(F.shiftleft(r.bitwiseAND(bits(not_high)), width + 1).bitwiseAND(bits(whole)))
        return r

    def step(r: Column, i: Column) -> Column:
        x = F.get(a, i)
        hits = [F.when(F.get(b, i + (j - edits)) == x, every << j).otherwise(0) for j in range(width)]
        hit = reduce(lambda p, q: p.bitwiseOR(q), hits).cast("long")
        moved = r.bitwiseOR(F.shiftright(r.bitwiseAND(bits(not_low)), 1))
        new = r.bitwiseAND(hit).bitwiseOR(F.shiftleft(moved, width).bitwiseAND(bits(whole)))
        return F.when(r == 0, r).otherwise(closed(new))

    start = 1 << edits
    for _ in range(edits):
        start |= (start & not_high) << (width + 1) & whole
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), steps - 1), bits(start), step)).otherwise(bits(start))


#: Characters after which most strings that are not alike have left the band.
_HEAD = 24


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are at ``edits`` or fewer edits."""
    width = 2 * edits + 1
    chars = lambda x: F.split(x, "")
    ends = F.call_function("shiftleft", F.lit(sum(1 << width * e for e in range(edits + 1))).cast("long"), F.length(b) - F.length(a) + edits)
    read = lambda x, y, n: _let(F.struct(chars(x).alias("a"), chars(y).alias("b")), lambda v: _read(v["a"], v["b"], edits, n))
    long_ones = F.length(a) > 2 * _HEAD
    head = read(F.substring(a, 1, _HEAD), F.substring(b, 1, _HEAD + edits), F.lit(_HEAD))
    return (
        F.when(F.abs(F.length(a) - F.length(b)) > edits, False)
        .when(F.length(a) == 0, True)
        .when(long_ones & (head == 0), False)
        .otherwise(read(a, b, F.length(a)).bitwiseAND(ends) != 0)
    )


def linked(a: Column, b: Column, edits: int = EDITS) -> Column:
    """``within`` on what is left between the common start and the common end."""
    rest = lambda p: F.struct(a.substr(p + 1, F.length(a)).alias("a"), b.substr(p + 1, F.length(b)).alias("b"))
    turned = lambda r: F.struct(F.reverse(r["a"]).alias("a"), F.reverse(r["b"]).alias("b"))
    shared = lambda r: _same_ends(r["a"], r["b"], F.least(F.length(r["a"]), F.length(r["b"])))
    core = lambda r: lambda p: F.struct(*[r[c].substr(p + 1, F.length(r[c])).alias(c) for c in ("a", "b")])
    return _let(
        _same_ends(a, b, F.least(F.length(a), F.length(b))),
        lambda p: _let(
            rest(p), lambda r: _let(turned(r), lambda t: _let(shared(t), lambda q: _let(core(t)(q), lambda c: within(c["a"], c["b"], edits))))
        ),
    )


def _pairs(rows: DataFrame) -> DataFrame:
    """``rows(key, id)``; positive ids are indexed and probe, negative ones probe -> pairs that may link."""
    left = rows.where("id > 0").select("key", F.col("id").alias("u"))
    right = rows.select("key", F.col("id").alias("w"), F.abs("id").alias("v"))
    other = (F.col("u") != F.col("v")) & ((F.col("w") < 0) | (F.col("u") < F.col("w")))
    met = left.join(right, (left["key"] == right["key"]) & other)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows that have one of the ids. A bitmap of at most ``2 ** (FILTER_BITS - 6)`` words takes out most others first."""
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
    word, bit = F.shiftright(at("id"), 6), F.call_function("shiftleft", F.lit(1).cast("long"), (at("id") % 64).cast("int"))
    bits = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    few = rows.join(F.broadcast(bits), word == F.col("_word")).where(F.col("_bits").bitwiseAND(bit) != 0)
    return few.drop("_word", "_bits").join(ids, "id")


def _met(make: Callable[[DataFrame], DataFrame], base: DataFrame, *contents: str) -> DataFrame:
    """The rows of ``make(base)``, which have ``key`` and a signed ``id``, whose key is shared and indexed, with ``crowd``.

    A key is left out if its rows agree in one of ``contents``: then a cell with fewer characters has their links. Rows are counted key by key in a window; keys that a look at
    a part of the ids finds in a great many rows are summed up instead, and their rows stay where they are.
    """
    look = make(base.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(LOOK)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    hot = look.where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(MOST_HOT).select("key").collect()  # so many at most
    rows = make(base)
    if hot:
        known = base.sparkSession.createDataFrame([(r["key"], True) for r in hot], "key long, hot boolean")
        rows = rows.join(F.broadcast(known), "key", "left")
    sums = {"crowd": F.count("*"), "high": F.max("id")} | {f"{f}_{c}": g(c) for c in contents for f, g in (("least", F.min), ("most", F.max))}
    by = W.partitionBy("key")
    told = (rows.where("hot is null").drop("hot") if hot else rows).withColumns({c: f.over(by) for c, f in sums.items()})
    if hot:
        warm = rows.where("hot").drop("hot")
        told = told.unionByName(warm.join(F.broadcast(warm.groupBy("key").agg(*[f.alias(c) for c, f in sums.items()])), "key"))
    keep = reduce(lambda x, y: x & y, [F.col(f"least_{c}") != F.col(f"most_{c}") for c in contents], F.col("crowd") > 1)
    return told.where(keep & (F.col("high") > 0)).drop(*[c for c in sums if c != "crowd"])


_CELL = ["l", "d", "s", "a1", "b1", "a2", "b2", "k"]


def _cells(lines: DataFrame) -> DataFrame:
    """One interval over the whole line, for each length ``d`` shorter of an indexed line, of ``lines(id, d, line, n)``."""
    length = (F.col("n") - F.col("d")).cast("int")
    signed = F.when(F.col("d") == 0, F.col("id")).otherwise(-F.col("id")).alias("id")
    none = F.lit(None).cast("int")
    return lines.select(
        signed, "line", length.alias("l"), "d", none.alias("s"), F.lit(0).alias("a1"), length.alias("b1"), none.alias("a2"), none.alias("b2"),
        F.lit(0).cast("long").alias("k"),
    )


def _finer(cells: DataFrame, edits: int, level: int) -> DataFrame:
    """Cells of the next level with their ``key``; ``c1`` and ``c2`` are hashes of what two intervals hold.

    One interval of level ``t`` is two neighbouring steps, ``k`` and ``k + 1``, of a grid of ``2 ** t`` steps over the indexed
    line, so intervals of one level overlap by a step and agree in it. A cell that several intervals hold is made by the
    last of them: two lines that share the key of one share it in all, so they meet there or have been paired there.
    """
    # of two lines of one length, that one probes whose insertion comes first, so a shift to the right is enough
    shifts = {d: ((0, 1) if d < 2 else (1,)) if edits > 1 else () for d in range(3)}
    # steps p to q, and r to w, of PIECES; 9: one interval. In a long one, edits in the same or the next step stay in one of
    # two steps; else steps are characters
    ends = lambda d: [(0, 2, 3, 4, d), (0, 1, 2, 3, d)]
    far = [_rows("p q r w s", [(0, 2, 0, 0, 9), (1, 3, 0, 0, 9), (2, 4, 0, 0, 9), *(x for s in shifts[d] for x in ends(s))]) for d in range(3)]
    every = [(i, j) for i in range(PIECES) for j in range(i + 1, PIECES)]
    close = [_rows("p q r w s", [*((i, i + 1, 0, 0, 9) for i in range(PIECES)), *((i, i + 1, j, j + 1, s) for i, j in every for s in shifts[d])]) for d in range(3)]
    plan = lambda x: F.when(F.col("d") == 0, x[0]).when(F.col("d") == 1, x[1]).otherwise(x[2])
    two = _rows("i j", [(i, j) for i in range(HALVES) for j in range(HALVES)])
    cut = lambda a, b, i, of: F.col(a) + _div((F.col(b) - F.col(a)) * i, of)
    size, k = F.col("b1") - F.col("a1"), F.col("k")
    step = lambda n, t: F.call_function("div", F.col("l").cast("long") * n, F.lit(1 << t).cast("long")).cast("int")
    last, middle = k == (1 << level) - 2, step(k + 1, level) - F.col("a1")
    own_far = F.filter(plan(far), lambda x: (x["p"] < 2) | last)
    own_close = F.filter(plan(close), lambda x: (x["q"] <= size) & (x["w"] <= size) & ((x["p"] < middle) | last))
    whole = cells.where("s is null").select("id", "line", "l", "d", "k", "a1", (size > PIECES).alias("long"), F.explode(F.when(size > PIECES, own_far).otherwise(own_close)).alias("at"))
    s, split = F.col("at.s"), F.col("at.s") != 9
    place = lambda x: F.when(F.col("long"), step(2 * k + F.col(f"at.{x}"), level + 1)).otherwise(F.col("a1") + F.col(f"at.{x}"))
    first = whole.select(
        F.when(split & (s != 0), -F.abs("id")).otherwise(F.col("id")).alias("id"), "line", "l", "d", F.when(split, s).alias("s"),
        place("p").alias("a1"), place("q").alias("b1"), F.when(split, place("r")).alias("a2"), F.when(split, place("w")).alias("b2"),
        F.when(~split & F.col("long"), 2 * k + F.col("at.p")).alias("k"),
    )
    i, j = F.col("at.i"), F.col("at.j")
    some = lambda a, b, a0, b0: (F.col(b) > F.col(a)) | (F.col(a0) == F.col(b0))
    both = cells.where("s is not null").select("id", "line", *_CELL, F.explode(two).alias("at"))
    ends = {"na1": ("a1", "b1", i), "nb1": ("a1", "b1", i + 1), "na2": ("a2", "b2", j), "nb2": ("a2", "b2", j + 1)}
    ends = {c: cut(*x, HALVES) for c, x in ends.items()}
    second = both.withColumns(ends).where(some("na1", "nb1", "a1", "b1") & some("na2", "nb2", "a2", "b2"))
    end = lambda a, b, x: (F.col(a) < F.col(b)) | (x == HALVES - 1)
    second = second.where(end("a1", "b1", i) & end("a2", "b2", j)).select(
        "id", "line", "l", "d", "s", *[F.col(f"n{c}").alias(c) for c in ("a1", "b1", "a2", "b2")], "k"
    )
    cells = first.unionByName(second)
    # what lies outside of the intervals, and inside; places are counted on the indexed line
    at = lambda a, b: F.substring("line", a + 1, b - a)
    a1, b1, a2, b2, l, d, s = (F.col(c) for c in ("a1", "b1", "a2", "b2", "l", "d", "s"))  # noqa: E741
    outside = F.when(s.isNull(), F.xxhash64(at(F.lit(0), a1), at(b1 + d, l + d))).otherwise(
        F.xxhash64(at(F.lit(0), a1), at(b1 + s, a2 + s), at(b2 + d, l + d))
    )
    # with the same characters from the left in the first interval, or from the right in the second, no edit lies in it
    inside = [F.when(s.isNull(), F.col("id")).otherwise(F.xxhash64(x, F.lit(n))) for n, x in ((1, at(a1, b1)), (2, at(a2 + d, b2 + d)))]
    return cells.select(
        F.xxhash64("l", "a1", "b1", F.coalesce("a2", F.lit(-1)), F.coalesce("b2", F.lit(-1)), outside).alias("key"),
        "id", "line", *_CELL, inside[0].alias("c1"), inside[1].alias("c2"),
    )


def _crowded_pairs(crowded: DataFrame, edits: int) -> DataFrame:
    """Pairs among ``crowded(id, d, line, n)`` that may link, by ever finer cells; a level with no crowd ends it."""
    cells, found = _cells(crowded), None
    for t in count(1):
        level = materialise(_met(lambda c, t=t: _finer(c, edits, t), cells, "c1", "c2"), "line-cells")
        done = (F.col("crowd") <= CROWD) | ((F.col("b1") - F.col("a1") <= 1) & F.coalesce(F.col("b2") - F.col("a2") <= 1, F.lit(True)))
        pairs = _pairs(level.where(done).select("key", "id"))
        found = pairs if found is None else found.union(pairs)
        cells = level.where(~done).select("id", "line", *_CELL).distinct()
        if cells.isEmpty():
            return found


def line_links(distinct: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``u, v``: ids of different lines of ``least_chars`` or more characters at ``edits`` (0 to 2) or fewer edits."""
    if edits not in (0, 1, 2):
        raise ValueError("edits must be 0, 1 or 2")
    least = max(least_chars, edits + 1)
    if not edits:
        return distinct.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    met = materialise(_met(lambda x: _segment_keys(x, edits, least), distinct.select("id", "line", "n")), "line-rows")
    ids = met.select(F.abs("id").alias("id")).distinct()
    texts = materialise(_among(distinct.select("id", "line", "n"), ids), "line-texts")
    pairs = _pairs(met.where(F.col("crowd") <= CROWD).select("key", "id"))
    crowded = met.where(F.col("crowd") > CROWD).select(F.abs("id").alias("id"), "d").distinct()
    if not crowded.isEmpty():
        pairs = pairs.union(_crowded_pairs(texts.join(crowded, "id"), edits))
    u = texts.select(F.col("id").alias("u"), F.col("line").alias("a"), F.col("n").alias("na"))
    v = texts.select(F.col("id").alias("v"), F.col("line").alias("b"), F.col("n").alias("nb"))
    both = pairs.distinct().join(u, "u").join(v, "v").where(F.abs(F.col("na") - F.col("nb")) <= edits)
    return both.where(linked(F.col("a"), F.col("b"), edits)).select("u", "v")


def line_classes(lines: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """For each line that repeats or links: ``h, h2, root, links, copies``, where ``root`` names its class."""
    distinct = distinct_lines(lines, "lines")
    links = materialise(line_links(distinct, edits, least_chars), "line-links")
    counted = links.select(F.col("u").alias("id")).union(links.select("v")).groupBy("id").agg(F.count("*").alias("links"))
    roots = connected_components(links).withColumnRenamed("u", "id")
    named = (
        distinct.select("id", "h", F.xxhash64("line", F.lit(1)).alias("h2"), "copies")
        .join(counted, "id", "left")
        .join(roots, "id", "left")
        .where("copies > 1 or links is not null")
    )
    return named.select("h", "h2", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies")


def _labelled(docs: DataFrame, edits: int, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines alone in their class, and those of other classes with ``leader``, the first of the class."""
    lines = document_lines(docs)
    slim = lines.select("doc_id", "mark", "line_no", "h", F.xxhash64("line", F.lit(1)).alias("h2"), F.length("line").alias("line_chars"))
    classes = materialise(line_classes(lines, edits, least_chars), "line-classes")
    found = materialise(slim.join(classes, ["h", "h2"], "left").drop("h", "h2"), "line-labels")
    shared = found.where("root is not null")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark", "line_no")
    leaders = shared.groupBy("root").agg(F.min(place).alias("leader"))
    return found.where("root is null"), shared.join(leaders, "root").withColumn("leads", place == F.col("leader"))


def label_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """A row per line that is not blank: ``doc_id, mark, line_no, line_chars, class_doc_id, class_line_no, links, copies, keep``.

    The class is named by its first occurrence, by doc_id (null first), a hash of the text, and line number; that one alone
    is kept. ``links`` counts the different lines within reach, ``copies`` the occurrences of the line itself. Null and
    empty texts have no lines; rows that agree in doc_id and text are one document and kept or dropped alike; other
    columns are ignored; an empty table gives an empty one.
    """
    alone, shared = _labelled(docs, edits, least_chars)
    whose = lambda d, i, links, copies, keep: [
        "doc_id", "mark", F.col("line_no").cast("int").alias("line_no"), "line_chars",
        d.alias("class_doc_id"), i.cast("int").alias("class_line_no"), links.cast("long").alias("links"), copies.cast("long").alias("copies"), keep.alias("keep"),
    ]
    own = whose(F.col("doc_id"), F.col("line_no"), F.lit(0), F.lit(1), F.lit(True))
    led = whose(F.col("leader.doc_id"), F.col("leader.line_no"), F.col("links"), F.col("copies"), F.col("leads"))
    return alone.select(*own).union(shared.select(*led))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents without lines that an earlier document or line has, all columns kept, whatever their names.

    Only lines go, so the first of each class always stays somewhere. Lines under ``least_chars`` characters stay: they
    repeat by chance. A document of which no line is left goes; one that had none (null, empty, blank) stays as it is.
    Rows that agree in doc_id and text lose the same lines; an empty table gives an empty one. A column ``n_chars`` follows
    the text.
    """
    repeats = _labelled(docs, edits, least_chars)[1].where(~F.col("leads") & (F.col("line_chars") >= least_chars))
    cut = repeats.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("lines"))
    key, own, other, cuts, new = fresh(docs, 5)
    changed = materialise(cut.select(F.col("doc_id").alias(own), F.col("mark").alias(other), F.col("lines").alias(cuts)), "line-changes")
    text = F.coalesce(F.col("text"), F.lit(""))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(key) == F.col(other))
    joined = docs.withColumn(key, F.xxhash64(text)).join(changed, on, "left")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(cuts), i))
    joined = joined.withColumn(new, F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    left = joined.where(F.col(cuts).isNull() | (F.btrim(new, F.lit(" \t\r\n")) != ""))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(new).alias("text"))
        elif c == "n_chars":
            changed_n = F.length(new).cast(docs.schema["n_chars"].dataType)
            columns.append(F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(changed_n).alias("n_chars"))
        else:
            columns.append(F.col(quoted(c)))
    return left.select(*columns)
