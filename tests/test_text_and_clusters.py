from datetime import datetime, timedelta

from colloquy import schema
from colloquy.functions.mail import is_bot
from colloquy.functions.text import html_to_text, normalize_subject, special_entities, stopwords, tokenize
from colloquy.operators import entities as E
from colloquy.operators.cluster import sessionise
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def messages(spark, rows):
    """``(sender, text, minute, channel, thread[, participant_only])``"""
    full = [(i, r[0], r[1], T0 + timedelta(minutes=r[2]), r[3], r[4], r[5] if len(r) > 5 else False, "t") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema.MESSAGES)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokenize(spark):
    words = lambda s, **k: one(spark, lambda c: tokenize(c, **k), s)
    assert words("budget project") == ["project"]
    assert words("budget project", strict_hex_filter=False) == ["budget", "project"]
    assert words("See https://x.org/Roadmap?q=1 me@host.org [media] <Media omitted> 2024-01-05 deadbeef99 +1-555-0100 -1372 Zürich's") == ["rich's"]
    assert words(None) == [] and words("on " * 50 + "x" * 40) == []
    assert {"the", "hadn", "jan", "sun", "opt-out", "you're"} <= stopwords() and not {"he'd", "cannot"} & stopwords()
    assert len(stopwords()) == 560 and words("able to also wait a bit longer", strict_hex_filter=False) == ["wait", "longer"]


def test_special_entities(spark):
    got = one(spark, special_entities, "Hi @Ann.B see #Dev-ops and https://A.org/x#Frag, mail c@d.org <https://z.io>")
    assert [(e["type"], e["value"]) for e in got] == [
        ("url", "https://A.org/x#Frag,"), ("url", "https://z.io"), ("mention", "ann.b"), ("mention", "d.org"), ("channel", "dev-ops"), ("channel", "frag"),
    ]


def test_html_subject_and_bots(spark):
    assert one(spark, html_to_text, "<style>p{}</style><p>A&nbsp;&lt;b&gt;</p>\n\n\n<div>c<br/>d</div><script>x</script>") == "A <b>\n\nc\nd"
    assert one(spark, normalize_subject, "Re: FW: Plan\n") == "fw: plan" and one(spark, normalize_subject, "fwd:  X ") == "x"
    rows = [("no-reply@x.org", "", True), ("a@github.com", "Ann", True), ("hello@y.ai", "", True), ("hello@y.org", "", False), ("", "Mail Delivery Subsystem (x)", True), (None, None, False)]
    df = spark.createDataFrame(rows, "e string, n string, want boolean")
    assert all(r.want == r.got for r in df.select("want", is_bot(F.col("e"), F.col("n")).alias("got")).collect())


def test_sessions(spark):
    rows = [
        ("a", "", 0, "x", None), ("b", "", 10, "x", None), ("a", "", 20.02, "x", None), ("c", "", 5, "x", "t1"), ("c", "", 500, "x", "t1"),
        ("d", "", 1, "", None), ("a", "", 24 * 60 - 1, "x", None), ("b", "", 24 * 60 + 8, "x", None), ("b", "", 3 * 24 * 60, "x", None), ("d", "", 2, None, ""),
    ]
    found, placed = sessionise(messages(spark, rows))
    got = {r.cluster_id: (r.channel, r.thread_id, r.participants, r.message_count) for r in found.collect()}
    assert got == {
        "cluster_0": ("x", None, ["a", "b"], 2), "cluster_1": ("x", None, ["a"], 1), "cluster_2": ("x", None, ["a", "b"], 2),
        "cluster_3": ("x", None, ["b"], 1), "cluster_4": ("x", "t1", ["c"], 2), "cluster_5": ("unknown", None, ["d"], 2),
    }
    assert placed.count() == len(rows)
    assert sessionise(messages(spark, []))[0].count() == 0


def test_sessions_do_not_depend_on_slices(spark):
    import random

    from colloquy.operators.cluster import gap_numbers

    r = random.Random(4)
    m = messages(spark, [("a", "", r.randrange(0, 3000), r.choice("xy"), None) for _ in range(300)])
    number = lambda s: {(x.seq, x.gap_no) for x in gap_numbers(m, 600, s).select("seq", "gap_no").collect()}
    assert number(600) == number(86_400) == number(10**9)


def found_entities(spark, texts, people=()):
    _, placed = sessionise(messages(spark, [("Zed", t, i, "x", None) for i, t in enumerate(texts)]))
    names = spark.createDataFrame([(0, p, []) for p in people], schema.PEOPLE) if people else None
    return {r.name: r.frequency for r in E.entities(placed, names).collect()}


def test_fold_depends_on_order(spark):
    assert found_entities(spark, ["system kangaroo systems"]) == {"system": 2, "kangaroo": 1}
    assert found_entities(spark, ["systems kangaroo system"]) == {"systems": 1, "kangaroo": 1, "system": 1}
    assert E.canonical("parties", {"party": 1}) == "party" and E.canonical("glass", {"glas": 1}) == "glass"
    assert E.canonical("proc manual", {"manual proc": 1}) == "manual proc" and E.canonical("processes", {"process": 1}) == "process"


def test_bigrams_cross_messages_and_take_from_terms(spark):
    got = found_entities(spark, ["manual report", "manual report", "x report"])
    assert got["manual report"] == 2 and "manual" not in got and got["report"] == 1
    assert "zoltan" not in found_entities(spark, ["zoltan kiss went kayaking"], ["Zoltan😎 Kiss"])


def test_idf_of_a_term_everywhere_counts_as_one(spark):
    _, placed = sessionise(messages(spark, [("z", "kayak kayak lake", 0, "x", None), ("z", "kayak hill", 60, "x", None)]))
    got = {(r.cluster_id, r.name): round(r.tfidf, 6) for r in E.tfidf(E.entities(placed), 2).collect()}
    assert got == {("cluster_0", "kayak"): 2.0, ("cluster_0", "lake"): 0.693147, ("cluster_1", "kayak"): 1.0, ("cluster_1", "hill"): 0.693147}
