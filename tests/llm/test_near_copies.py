import random
from itertools import combinations

import corpus_pipeline
from colloquy.llm import near_copies


def test_stage_keeps_one_of_each_near_copy(spark, docs_of):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for base in range(12):
        words = [word() for _ in range(r.choice((6, 60, 300)))]
        rows.append((base, " ".join(words)))
        for c in range(3):
            copy = list(words)
            for _ in range(max(1, len(words) * c // 50)):
                copy[r.randrange(len(copy))] = word()
            rows.append((100 + 10 * base + c, " ".join(copy)))
    passage = [word() for _ in range(300)]  # a crowd of 60 below 0.8 of each other, with three pairs above
    crowd = [passage + [word() for _ in range(90)] for _ in range(60)]
    crowd += [x[:-4] + [word() for _ in range(4)] for x in crowd[:3]]
    rows += [(500 + i, " ".join(x)) for i, x in enumerate(crowd)]
    rows += [(900, rows[0][1].upper()), (901, ""), (902, None), (903, " \n"), (None, rows[0][1])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if x == old else x for x in root]
    want = {min(rows[i][0] for i, x in enumerate(root) if x == c and rows[i][0] is not None) for c in set(root)} | {None}
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    docs = docs_of(rows)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, want))
    assert len(want) < len(rows) - 20
    assert near_copies.one_of_each(docs_of([])).count() == 0


def test_crowds_lose_no_pair(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 1)
    monkeypatch.setattr(near_copies, "DEPTH", 1, raising=False)  # where the code before stopped
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(300)]  # 200 texts at 296 / 372, which share most bands; twelve pairs of them at 297 / 371
    own = [[word() for _ in range(38)] for _ in range(200)]
    for i in range(12):
        own[100 + i][0] = own[i][0]
    rows = [(i, " ".join(passage + x)) for i, x in enumerate(own)]
    found = near_copies.near_copies(docs_of(rows)).collect()
    assert {x.doc_id: x.component_id for x in found} == {i: i - 100 if 100 <= i < 112 else i for i in range(200)}


def test_large_crowds_of_two_roots(spark, docs_of):
    """Pairs that only the shingles of a crowd tell: two large families, held together by one text between them."""
    rows = [(1, 1, "a b c d e f g h i j k l"), (2, 1, "a b c d e f g h i j k m"), (3, 2, "a b c d e f g h i j k l n"), (4, 3, "p q r s t u v")]
    crowd = spark.createDataFrame([(m, root) for m, root, _ in rows], "mark long, root long")
    members = spark.createDataFrame([(m, t) for m, _, t in rows], "mark long, text string")
    assert [tuple(x) for x in near_copies._crowd_pairs(crowd, members, 0.8).collect()] == [(3, 1)]


def test_roots_of_a_crowd_meet_only_where_enough_is_left(spark):
    """A hundred roots share the first shingle of a passage that is too short for any pair, but for two at 90 of 100."""
    keys = [(1, i, i, 100, 85) for i in range(100)] + [(1, 200, 200, 100, 90), (1, 201, 201, 100, 90), (1, 202, 202, 100, 88), (2, 300, 300, 10, 10), (2, 300, 301, 10, 10), (2, 302, 302, 9, 9)]
    rows = spark.createDataFrame(keys, "s long, root long, mark long, n long, left long")
    assert sorted(tuple(x) for x in near_copies._root_pairs(rows, 0.8).collect()) == [(1, 201, 200), (2, 302, 300)]
