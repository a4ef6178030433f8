import random
from itertools import combinations

import pytest
from colloquy.llm import components, lines, multiset, near_copies, simhash
from colloquy.llm.components import connected_components
from pyspark.sql import functions as F


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_rounds_over_few_edges_exchange_nothing(spark, monkeypatch, few):
    r = random.Random(3)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(20)] + [(300, 301 + i) for i in range(20)] + [(7, None), (8, 8)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in root:
        for u, v in edges:
            if u in root and v in root:
                root[u] = root[v] = min(root[u], root[v])
    plans, write = [], components.materialise
    monkeypatch.setattr(components, "FEW", few, raising=False)
    monkeypatch.setattr(components, "materialise", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, tag))
    got = {x.u: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root
    assert len(plans) > 2
    if few > len(edges):
        assert not [p for p in plans[1:] if "Exchange" in p]



def test_simhash_links_match_all_pairs(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(3):
            for b in r.sample(range(64), r.choice((1, 2, 3))):
                f ^= 1 << b
            fps.append(f)
    fps = list(dict.fromkeys(f - (1 << 64) if f >> 63 else f for f in fps))
    got = {x.u: x.root for x in connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    near = [(i, j) for i, j in combinations(range(len(fps)), 2) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2]
    want = union_find(len(fps), near)
    groups = lambda names: {frozenset(i for i, x in enumerate(names) if x == n) for n in names}
    assert groups([got.get(f, f) for f in fps]) == groups(want)


def test_simhash_fingerprint_of_each_bit():
    from xxhash import xxh64

    r = random.Random(8)
    words = [r.choice(["Ab", "é", "zz", "É", "x" * 30]) + str(r.randrange(50)) for _ in range(300)]
    for text, n in ((" ".join(words), 3), ("\t".join(words[:40]) + "\n", 5), ("one TWO", 3), ("", 3), (None, 3)):
        parts = ["".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").split()]
        runs = [" ".join(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))] if parts else []
        h = [xxh64(x.encode(), seed=42).intdigest() for x in runs]
        assert simhash.fingerprint(text, n) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_segments_and_crowds(spark, monkeypatch):
    r = random.Random(12)
    base = [r.getrandbits(64) for _ in range(30)]
    family = [base[0] ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for _ in range(150)]
    fps = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(base + family + [f ^ 5 << 40 for f in base])]
    near = [(i, j) for i, j in combinations(range(len(fps)), 2) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2]
    want = union_find(len(fps), near)
    groups = lambda names: {frozenset(i for i, x in enumerate(names) if x == n) for n in names}
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    for crowd, segments in ((1_000, 2), (8, 2), (8, 1), (8, 3)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {x.u: x.root for x in connected_components(simhash.links(rows, segments=segments)).collect()}
        assert groups([got.get(f, f) for f in fps]) == groups(want)
    monkeypatch.setattr(simhash, "CROWD", 1_000)
    assert {tuple(sorted(x)) for x in simhash.links(rows).collect()} == {tuple(sorted((fps[i], fps[j]))) for i, j in near}


def test_one_of_each_knows_rows_by_id_and_text(docs_of):
    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = docs_of([(3, a), (5, b), (5, a), (7, a.upper()), (7, " ".join(f"c{i}" for i in range(90))), (7, " ".join(f"d{i}" for i in range(90)))])
    for stage in (simhash.one_of_each, near_copies.one_of_each):
        assert sorted((r.doc_id, r.text[0]) for r in stage(rows).collect()) == [(3, "a"), (5, "b"), (7, "c"), (7, "d")]


def test_simhash_rows(docs_of):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (7, " \t\n"), (1, "one two"), (None, text), (5, text), (2, "long " * 50_000)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    fp = f"{simhash.fingerprint(text):016x}"
    assert {(5, fp, 3), (3, fp, 3), (None, fp, 3), (9, "0" * 16, 7), (8, "0" * 16, 7), (7, "0" * 16, 7)} <= got
    stay = simhash.one_of_each(docs_of(rows))
    assert stay.columns == docs_of(rows).columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["1", "2", "3", "7", "None"]
    assert simhash.near_duplicates(docs_of([])).count() == 0 and simhash.one_of_each(docs_of([])).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def room(n):
    return 0 if n < 10 else 2


def mutated(r, s, k):
    for _ in range(k):
        i = r.randrange(len(s) + 1)
        s = r.choice([s[:i] + r.choice("abcé ") + s[i:], s[:i] + s[i + 1 :], s[:i] + r.choice("xyz") + s[i + 1 :]])
    return s


def test_line_links_match_all_pairs(docs_of):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefg hij") for _ in range(n)).strip() or "q" for n in [5, 9, 10, 11, 18, 19, 20, 21, 22, 40, 80, 150, 300]]
    base += ["template with a slot " + "".join(r.choice("abcdefghij") for _ in range(8)) + " and a common end" for _ in range(60)]
    texts = base + [mutated(r, b, k) for b in base for k in (1, 2, 3)]
    docs = [(i, t.strip()) for i, t in enumerate(texts)]
    docs += [(500, None), (501, ""), (502, " \n\t\n"), (503, "\n".join(base[:3])), (503, "\n".join(base[:3]))]
    rows = lines.label_lines(docs_of(docs)).collect()
    distinct = {}
    for i, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r"):
                distinct.setdefault(x.strip(" \t\r"), []).append((i, n))
    names = list(distinct)
    near = [(a, b) for a, b in combinations(range(len(names)), 2) if edits(names[a], names[b]) <= room(min(len(names[a]), len(names[b])))]
    roots = union_find(len(names), near)
    lead = {}
    for i, x in enumerate(names):
        lead[roots[i]] = min(lead.get(roots[i], (10**9, 0)), min(distinct[x]))
    want = {(d, n): (lead[roots[i]], sum(i in p for p in near), len(distinct[x])) for i, x in enumerate(names) for d, n in distinct[x]}
    assert len(near) > 60
    assert {(r.doc_id, r.line_no): ((r.class_doc_id, r.class_line_no), r.links, r.copies) for r in rows} == want
    assert all(r.keep == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in rows)


def test_numbered_template_lines(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "LOOK", 1)  # some keys count as hot
    monkeypatch.setattr(lines, "HOT", 200)
    r = random.Random(6)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = [f"Order {number(5)} was shipped to you" for _ in range(300)] + [f"{number(2)} items of kind {number(3)} were sold in all" for _ in range(150)]
    texts += ["Order " + mutated(r, x[6:11], 2) + x[11:] for x in texts[:20]]
    names = sorted(set(texts))
    near = [(a, b) for a, b in combinations(names, 2) if abs(len(a) - len(b)) <= 2 and a[:3] == b[:3] and edits(a, b) <= 2]
    near += [(a, b) for a, b in combinations(names, 2) if abs(len(a) - len(b)) <= 2 and a[:3] != b[:3] and edits(a, b) <= 2]
    rows = lines.label_lines(docs_of(list(enumerate(names)))).collect()
    links = {n: sum(n in p for p in near) for n in names}
    assert {names[x.doc_id]: x.links for x in rows} == links and sum(links.values()) > 400


def test_lines_leave_documents(docs_of):
    boiler = "this line of some length stands in many documents"
    docs = [(1, boiler + "\nfirst text of its own and some more words to keep it"), (2, boiler + ".\nsecond text, quite another one, with words of its own\nYes."), (3, boiler), (4, None), (5, ""), (6, "Yes.")]
    docs += [(7, "\n".join([boiler] * 20 + ["unique short fact"]))]
    out = {r.doc_id: (r.text, r.n_chars) for r in lines.without_repeated_lines(docs_of(docs)).collect()}
    second = "second text, quite another one, with words of its own\nYes."
    assert out == {1: (docs[0][1], len(docs[0][1])), 2: (second, len(second)), 4: (None, 0), 5: ("", 0), 6: ("Yes.", 4), 7: ("unique short fact", 17)}
    assert lines.without_repeated_lines(docs_of([])).count() == 0 and lines.label_lines(docs_of([])).count() == 0


def test_bit_parallel_distance(spark):
    r = random.Random(9)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("abcé") for _ in range(r.randrange(0, 14)))
        b = mutated(r, a, r.randrange(0, 4))
        rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("*", *[lines.linked(F.col("a"), F.col("b"), k).alias(f"near{k}") for k in range(3)]).collect()
    assert all(x[f"near{k}"] == (edits(x.a, x.b) <= k) for x in got for k in range(3))


def test_multiset_is_homomorphic_and_ignores_order(spark):
    df = spark.createDataFrame([("alpha one\nbeta two\ngamma three", "gamma three\nalpha one\nbeta two", "beta two", "alpha one\ngamma three")], "t string, o string, p string, rest string")
    fp = {c: multiset.fingerprint(F.col(c)) for c in df.columns}
    row = df.select(*[f.alias(c) for c, f in fp.items()]).select(
        (F.col("t") == F.col("o")).alias("order"),
        (multiset.combine(F.col("rest"), F.col("p")) == F.col("t")).alias("insert"),
        (multiset.combine(F.col("t"), F.col("p"), -1) == F.col("rest")).alias("delete"),
        (F.col("t") == F.col("rest")).alias("differs"),
    ).first()
    assert (row.order, row.insert, row.delete, row.differs) == (True, True, True, False)


def test_next_document_over_many_runs(docs_of, monkeypatch):
    import hashlib

    monkeypatch.setattr(multiset, "RUN_ROWS", 3)
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["sun", "moon", "tide", "sand,", "wind."]) for _ in range(r.randrange(0, 60)))) for i in r.sample(range(1000), 80)]
    docs += [(2000, None), (2001, "")]
    got = {x.doc_id: x for x in multiset.edited_likeness(docs_of(docs)).collect()}
    order = sorted(docs, reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = {}
    for i, t in docs:
        same.setdefault(got[i].fingerprint, set()).add(t or "")
    assert all(len(v) == 1 for v in same.values())


def test_likeness_follows_the_edit(docs_of):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    docs = [(i, " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(400))) for i in range(20)]
    rows = multiset.edited_likeness(docs_of(docs)).collect()
    assert all(x.near_edited > 0.45 and x.near_next < 0.35 for x in rows)


def test_pieces_of_any_script(docs_of):
    r = random.Random(4)
    kinds = [range(0x4E00, 0x9FFF), range(0xAC00, 0xD7A3), range(0x430, 0x44F), range(0xE01, 0xE2E), range(0x20000, 0x2A6D0), range(0x61, 0x7A)]
    docs = [(10 * k + i, "".join(chr(r.choice(kind)) for _ in range(3000))) for k, kind in enumerate(kinds) for i in range(6)]
    rows = multiset.edited_likeness(docs_of(docs)).collect()
    likely = [x.near_edited for x in rows]
    assert min(likely) > 0.35 and 0.5 < sum(likely) / len(likely) < 0.8 and max(x.near_next for x in rows) < 0.4, (likely, [x.near_next for x in rows])


def test_lanes_wrap_within_themselves(spark):
    """Against plain sums of big integers, past the width of a lane."""
    df = spark.range(1).select(F.expr("concat_ws('\n', transform(sequence(1, 1300), i -> concat('line ', i % 7)))").alias("t"))
    fp = df.select(multiset.fingerprint(F.col("t")).alias("fp")).select("fp", multiset.combine(F.col("fp"), F.col("fp")).alias("twice"))
    for _ in range(10):
        fp = spark.createDataFrame(fp.collect(), fp.schema).select("fp", multiset.combine(F.col("twice"), F.col("twice")).alias("twice"))
    got = fp.select("*", multiset.combine(F.col("twice"), F.col("fp"), -1).alias("less")).first()
    lanes = lambda w: [w >> 21 * i & (1 << 21) - 1 for i in range(3)]
    one = [x for w in got.fp.sums[1:] for x in lanes(w)]
    assert [x for w in got.twice.sums[1:] for x in lanes(w)] == [(x << 11) % (1 << 20) for x in one] and max(one) << 11 > 1 << 20
    assert [x for w in got.less.sums[1:] for x in lanes(w)] == [((x << 11) - x) % (1 << 20) for x in one]
    assert (got.twice.sums[0], got.less.sums[0]) == (1300 << 11, (1300 << 11) - 1300)
    assert [e % (1 << 32) for e in got.twice.exact] == [(e << 11) % (1 << 32) for e in got.fp.exact]


def test_next_of_repeated_ids(docs_of, monkeypatch):
    monkeypatch.setattr(multiset, "RUN_ROWS", 4)
    docs = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(30)] + [(i, f"own {i}") for i in range(20)]
    got = multiset.with_next(docs_of(docs).select("doc_id", "text"), ["doc_id", "text"]).collect()
    after = {x.text: x.next_text for x in got}
    assert len(after) == len(docs) == len(set(after.values()))
    walk, at = [], "own 19"
    for _ in docs:
        walk.append(at)
        at = after[at]
    ids = dict((t, i) for i, t in docs)
    order = [ids[t] for t in walk]
    assert at == "own 19" and order[-40:] == [None] * 40 and order[:-40] == sorted(order[:-40], reverse=True)


def test_lone_and_empty_tables(docs_of):
    one = multiset.edited_likeness(docs_of([(1, "abcdef")])).first()
    assert one.near_next == 1.0 and multiset.edited_likeness(docs_of([])).count() == 0
    twice = multiset.edited_likeness(docs_of([(1, "same"), (1, "same"), (None, "x")])).collect()
    assert len(twice) == 3


def _prose(seed, n, size=60):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop ") for _ in range(size)).strip().replace("  ", " x") for _ in range(n)]


def test_every_line_stays_once(docs_of):
    ten, (shared,), own, fresh = _prose(1, 10), _prose(2, 1), _prose(3, 4), _prose(4, 4)
    scraps = [(i, "\n".join([*ten[:9], x])) for i, x in zip((3, 4, 5, 6), fresh, strict=True)]
    docs = [(0, "\n".join(ten)), (1, "\n".join([*ten[:9], shared])), (2, "\n".join([shared, *own])), *scraps, (7, "\n".join(fresh)), (8, "\n".join(fresh))]
    clash = docs_of(docs).withColumnsRenamed({"mark": "_x0", "h": "_x3", "id": "lines"})
    found = lines.without_repeated_lines(clash)
    assert found.columns == clash.columns
    out = {r.doc_id: r.text for r in found.collect()}
    assert out == {0: "\n".join(ten), 1: shared, 2: "\n".join(own)} | dict(zip((3, 4, 5, 6), fresh, strict=True))


def test_repeats_within_a_document_do_not_count_as_copies(docs_of):
    line, table = "one line that stands six times and in no other document", [f"a row of the table with number {i}" for i in range(30)]
    docs = [(0, "\n".join([line] * 6)), (1, "\n".join(table)), (None, "\n".join(["a document without any id says this"] * 6))]
    out = {r.doc_id: r.text for r in lines.without_repeated_lines(docs_of(docs)).collect()}
    assert out == {0: line, 1: table[0], None: "a document without any id says this"}
