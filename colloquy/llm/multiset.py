"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A fingerprint is the sum of one wide vector per paragraph, each lane modulo a power of two, so it does not depend on the
order of paragraphs, and adding or taking away a paragraph adds or takes away its vector. A paragraph's vector has two
parts. Four lanes modulo 2**32 are hashed from the whole paragraph and decide equality. 120 lanes modulo 2**20, packed
three to a 64-bit word, add up one hashed bit per piece of the paragraph. Pieces end at blanks after punctuation or after a word
whose last letter is one of a fixed few; what is longer than ``LONG`` bytes, as text in scripts without blanks or letters
of these, is cut after ``SHORT`` or more characters, at the first of a class that takes about an eighth of any script. So
pieces depend on what stands around their ends, and an edit disturbs only the pieces that it touches. Lane counts ``c`` of ``n`` pieces
give the signed sums ``2c - n`` of random signs, whose normalised inner product estimates the cosine of two multisets of
pieces: the likeness of two fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

EXACT_LANES = 4
#: Packed words per hash, and hashes per piece: 3 * 20 * 2 = 120 lanes.
WORDS, HASHES = 20, 2
LANE_BITS, STRIDE = 20, 21
_LANE = (1 << LANE_BITS) - 1
_ONES = 1 | 1 << STRIDE | 1 << 2 * STRIDE
#: The lanes of a word, and the bits above each that take a carry or lend one.
_LANES, _GUARDS = _LANE * _ONES, _ONES << LANE_BITS
PARAGRAPH = r"\n"
PIECE_END = r"(?<=[,.;:!?dgsy])[ \t\r]+|\n"
LONG = 64
#: Documents of one run of the order by id, and the most runs: a bound on the table of their limits.
RUN_ROWS, MOST_RUNS = 2_000, 1 << 16


def _eighth() -> str:
    """A class of about an eighth of all characters: two of 16 code points up to U+2E80, 64 of 512 above."""
    code = lambda c: f"\\x{{{c:x}}}"
    low = "".join(code(c) for c in range(0x21, 0x100) if c % 16 in (2, 3))
    groups = []
    for start, end, step, size in [(a, a + 0x200, 16, 2) for a in range(0x100, 0x2E00, 0x200)] + [(0x2E00, 0x10000, 512, 64), (0x10000, 0x20000, 4096, 512)]:
        runs = "".join(f"{code(c)}-{code(c + size - 1)}" for c in range(start, end, step))
        groups.append(f"[{code(start)}-{code(end - 1)}&&[{runs}]]")
    return f"[{low}{''.join(groups)}]"


#: A run of at least ``SHORT`` characters up to one of the class, or what is left.
SHORT = 6
DENSE = f"(?s).{{{SHORT},}}?(?<={_eighth()})|.+"


def exact_lanes(text: Column) -> Column:
    """Sums of the paragraphs' hashes, modulo 2**32 each."""
    parts = F.split(text, PARAGRAPH)
    low, high = F.lit((1 << 32) - 1).cast("long"), 32
    zero = F.struct(*[F.lit(0).cast("long").alias(f"e{i}") for i in range(EXACT_LANES)])

    def add(acc: Column, p: Column) -> Column:
        h = [F.xxhash64(p), F.xxhash64(p, F.lit(1))]
        lanes = [x for v in h for x in (v.bitwiseAND(low), F.shiftrightunsigned(v, high))]
        return F.struct(*[(acc[f"e{i}"] + x).bitwiseAND(low).alias(f"e{i}") for i, x in enumerate(lanes)])

    return F.aggregate(parts, zero, add, lambda a: F.array(*[a[f"e{i}"] for i in range(EXACT_LANES)]))


def piece_sums(text: Column) -> Column:
    """``array<bigint>``: the number of pieces, then the packed lane counts."""
    finer = lambda p: F.when(F.octet_length(p) > LONG, F.regexp_extract_all(p, F.lit(DENSE), F.lit(0))).otherwise(F.array(p))
    cut = lambda ps: F.when(F.exists(ps, lambda p: F.octet_length(p) > LONG), F.flatten(F.transform(ps, finer))).otherwise(ps)
    pieces = F.get(F.transform(F.array(F.split(text, PIECE_END)), cut), F.lit(0))  # the split is computed once
    ones, lanes = F.lit(_ONES).cast("long"), F.lit(_LANES).cast("long")
    names = ["n", *(f"s{h}_{j}" for h in range(HASHES) for j in range(WORDS))]
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names])
    hashes = F.transform(pieces, lambda p: F.struct(F.xxhash64(p).alias("h0"), F.xxhash64(p, F.lit(1)).alias("h1")))

    def add(acc: Column, x: Column) -> Column:
        bits = [
            (acc[f"s{h}_{j}"] + F.shiftrightunsigned(x[f"h{h}"], j).bitwiseAND(ones)).bitwiseAND(lanes).alias(f"s{h}_{j}")
            for h in range(HASHES)
            for j in range(WORDS)
        ]
        return F.struct((acc["n"] + 1).alias("n"), *bits)

    return F.aggregate(hashes, zero, add, lambda a: F.array(*[a[c] for c in names]))


def fingerprint(text: Column) -> Column:
    """``struct<exact: array<bigint>, sums: array<bigint>>`` of a text without nulls."""
    return F.struct(exact_lanes(text).alias("exact"), piece_sums(text).alias("sums"))


def as_string(fp: Column) -> Column:
    exact = F.transform(fp["exact"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    sums = F.transform(F.slice(fp["sums"], 2, HASHES * WORDS), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.concat(F.array_join(exact, ""), F.lit("-"), F.array_join(sums, ""))


def _signed(sums: Column) -> Column:
    """The lanes' sums of signs. A lane has a count modulo ``2 ** LANE_BITS``: the one nearest to half of all pieces is meant."""
    n, wrap = F.element_at(sums, 1).cast("double"), float(1 << LANE_BITS)
    count = lambda x, i: F.shiftrightunsigned(x, i * STRIDE).bitwiseAND(F.lit(_LANE).cast("long")).cast("double")
    wrapped = lambda c: 2.0 * (c + wrap * F.floor((n / 2 - c) / wrap + 0.5)) - n
    lane = lambda c: F.when(n < wrap, 2.0 * c - n).otherwise(wrapped(c))
    return F.flatten(
        F.transform(F.slice(sums, 2, HASHES * WORDS), lambda x: F.array(*[lane(count(x, i)) for i in range(3)]))
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated cosine of the two multisets of pieces; 1 for equal fingerprints."""
    products = lambda v: F.struct(*[_dot(v[i], v[j]).alias(i + j) for i, j in ("xx", "yy", "xy")])

    def bounded(d: Column) -> Column:
        size = F.sqrt(d["xx"]) * F.sqrt(d["yy"])
        cosine = F.when(size > 0, d["xy"] / size).otherwise(0.0)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))

    signs = F.array(F.struct(_signed(a["sums"]).alias("x"), _signed(b["sums"]).alias("y")))  # each computed once
    return F.when(a == b, 1.0).otherwise(F.get(F.transform(F.transform(signs, products), bounded), F.lit(0)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint after the paragraphs of ``b`` are inserted (1) or deleted (-1)."""
    low = F.lit((1 << 32) - 1).cast("long")
    lanes, guards = F.lit(_LANES).cast("long"), F.lit(_GUARDS).cast("long")
    packed = lambda x, y: (x + y if sign > 0 else x.bitwiseOR(guards) - y).bitwiseAND(lanes)
    words = lambda v: F.slice(v["sums"], 2, HASHES * WORDS)
    n = F.element_at(a["sums"], 1) + sign * F.element_at(b["sums"], 1)
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: (x + sign * y).bitwiseAND(low)).alias("exact"),
        F.concat(F.array(n), F.zip_with(words(a), words(b), packed)).alias("sums"),
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns and ``fp``; null text counts as empty."""
    return docs.withColumn("fp", fingerprint(F.coalesce(F.col(text_col), F.lit(""))))


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``next_<c>`` of the next document in descending ``doc_id`` order; after the last comes the first.

    ``columns`` include ``doc_id`` and ``text``; ``derived`` columns are computed from them once the rows are placed, so
    that finding the runs' first rows does not compute them for all rows again. The order is cut into runs of about ``RUN_ROWS`` ids; the first row of
    each run is also put behind the run before it, so no row but these is moved twice. Null ids come last; rows of one
    id are ordered by a hash of their text, and an id that fills several runs is cut by that hash.
    """
    rows = docs.select("doc_id").count()
    derived = derived or {}
    if not rows:
        docs, columns = docs.select(*columns).withColumns(derived), [*columns, *derived]
        return docs.select(*columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    keyed = docs.select(*columns).withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    keyed = keyed.withColumn("_hash", F.xxhash64("text"))
    runs = max(2, min(MOST_RUNS, -(-rows // RUN_ROWS)))
    limits = keyed.select(F.percentile_approx("_key", [i / runs for i in range(1, runs)], 50 * runs).alias("_limits"))
    limits = materialise(limits, "runs")  # one row of at most MOST_RUNS numbers
    # how many limits are below the key, and how many equal it: an id that fills several runs
    halves = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
    at = lambda test: F.aggregate(halves, F.lit(0), lambda p, k: F.when(test(F.get("_limits", p + k - 1)), p + k).otherwise(p))
    placed = keyed.join(F.broadcast(limits)).withColumns({"_below": at(lambda x: x < F.col("_key")), "_upto": at(lambda x: x <= F.col("_key"))})
    part = 1.0 - (F.col("_hash").cast("double") + 2.0**63) / 2.0**64
    same = F.col("_upto") - F.col("_below")
    within = F.when(same > 1, F.least(F.floor(part * same), same - 1)).otherwise(0).cast("int")
    placed = placed.withColumn("_run", F.lit(runs) - F.col("_below") - within).drop("_limits", "_below", "_upto")
    order = [F.col("_key").desc(), F.col("_hash"), F.col("text")]
    first = F.min(F.struct((-1 - F.col("_key")).alias("down"), F.col("_hash").alias("hash"))).alias("first")  # -1 - x turns the order around
    tops = materialise(placed.groupBy("_run").agg(first), "tops")  # a row per run
    before = F.coalesce(F.lag("_run").over(W.orderBy("_run")), F.max("_run").over(W.partitionBy()))
    tops = tops.select("_run", before.alias("_to"), (-1 - F.col("first.down")).alias("_key"), F.col("first.hash").alias("_hash"))
    heads = placed.join(F.broadcast(tops), ["_run", "_key", "_hash"])
    heads = heads.withColumn("_place", F.row_number().over(W.partitionBy("_to").orderBy("text"))).where("_place = 1")
    heads = heads.select(*columns, "_key", "_hash", F.col("_to").alias("_run"), F.lit(1).alias("_ghost"))
    both = placed.withColumn("_ghost", F.lit(0)).unionByName(heads).withColumns(derived)
    columns = [*columns, *derived]
    w = W.partitionBy("_run").orderBy("_ghost", *order)
    nexts = [F.lead(c).over(w).alias(f"next_{c}") for c in columns]
    return both.select(*columns, "_ghost", *nexts).where("_ghost = 0").drop("_ghost")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text's last ``floor(n_chars / 3)`` code points are the next document's first as many, or all it has.
    Null and empty texts have one empty paragraph; a lone document is its own next; repeated rows follow each other.
    Lanes wrap around in very long texts, which changes neither equality nor, but for texts that say the same over a
    million times, the likeness.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(base, ["doc_id", "text"], {"fp": fingerprint(F.col("text"))})
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "fp",
        F.col("next_fp").alias("nfp"),
        F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"),
    )
    marked = edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fp",
        fingerprint(F.col("edited")).alias("efp"),
        "nfp",
    )
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
