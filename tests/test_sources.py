import base64
import json
from datetime import datetime

from colloquy.cli import main
from colloquy.sources import email_text, gmail, mbox, slack, whatsapp
from colloquy.sources.common import ingest, resolve_format


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("seq").select(*names).collect()]


def test_formats():
    assert [resolve_format(*a) for a in (("x.txt",), ("x.mbox",), ("dir",), ("x.txt", "email"), ("x.mbox", "gmail"))] == ["whatsapp", "mbox", "slack", "mbox", "mbox"]


def slack_export(root):
    put = lambda name, value: ((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_text(value if isinstance(value, str) else json.dumps(value)))
    put("users.json", [{"id": "U1", "name": "ann", "profile": {"display_name": "", "real_name": "Ann Lee"}}, {"id": "U2", "name": "bob", "profile": {"display_name": "Bobby"}}])
    put("channels.json", [{"id": "C1", "name": "general"}])
    put("mpims.json", [{"id": "G1", "name": "trio", "is_mpim": True}])
    put("general/2024-01-01.json", [
        {"ts": "1704067200.000100", "user": "U1", "text": "root <@U2> and <@U9>", "thread_ts": "1704067200.000100"},
        {"ts": "1704067201.000200", "user": "U2", "text": "reply", "thread_ts": "1704067200.000100"},
        {"ts": "1704067202.0", "user": "U1", "text": "joined", "subtype": "channel_join"},
        {"ts": "1704067203.5", "bot_id": "B1", "text": "bot", "subtype": "thread_broadcast"},
        {"ts": "1704067204.5", "text": "nobody"},
    ])
    put("general/2024-01-02.json", "{broken")
    put("trio/2024-01-01.json", [{"ts": "1704067300.0", "user": "U7", "text": "x"}])


def test_slack(spark, tmp_path):
    slack_export(tmp_path)
    found = slack.read(spark, str(tmp_path))
    assert rows(found.channels, "name", "channel_type") == [("general", "channel"), ("trio", "group")]
    got = {r.text: (r.sender, r.thread_id, r.channel) for r in found.messages.collect()}
    assert got == {
        "root @Bobby and @U9": ("Ann Lee", None, "general"), "reply": ("Bobby", "1704067200.000100", "general"), "bot": ("B1", None, "general"),
        "nobody": ("unknown", None, "general"), "x": ("U7", None, "trio"),
    }
    assert found.messages.where("text = 'reply'").first().ts == datetime(2024, 1, 1, 0, 0, 1, 200)


CHAT = (
    "﻿25/12/2023, 14:05 - Ann: hello\r\n‎[25/12/23, 2:05:09 PM] Bob: <Media omitted>\n1/2/24, 12:00 AM - Ann: line one\ncontinued line\n\n  more \n"
    "25/12/2023, 14:06 - Messages are end-to-end encrypted\nstill more\n2/2/24, 10:00 - You added Cid: x\nlost line\n3/13/24, 9:07 - Ann: over\n"
)


def test_whatsapp(spark, tmp_path):
    path = tmp_path / "WhatsApp Chat with Bob.txt"
    path.write_text(CHAT, encoding="utf-8")
    found = whatsapp.read(spark, str(path))
    assert rows(found.messages, "sender", "text", "ts", "channel") == [
        ("Ann", "hello", datetime(2023, 12, 25, 14, 5), "Bob"), ("Bob", "[media]", datetime(2023, 12, 25, 14, 5, 9), "Bob"),
        ("Ann", "line one\ncontinued line\nmore\nstill more", datetime(2024, 2, 1, 0, 0), "Bob"), ("Ann", "over", datetime(2025, 1, 3, 9, 7), "Bob"),
    ]
    assert rows(found.channels, "name", "channel_type") == [("Bob", "dm")]
    assert whatsapp.ingest_text(spark, CHAT).messages.count() == 4 and whatsapp.ingest_text(spark, "").messages.count() == 0


MBOX = """preamble
From a@x Mon Jan 1
From: "Ann Lee" <Ann@X.org>
To: Bob <bob@y.org>, cy@z.org
Subject: =?UTF-8?B?UGzDpG4=?=
Date: Mon, 01 Jan 2024 10:00:00 +0000
Message-ID: <m1@x>

Hi all
> quoted
never

From b@y Mon Jan 1
From: bob@y.org
To: ann@x.org
Subject: Re: =?utf-8?Q?Pl=C3=A4n?=
 folded
Date: nonsense
References: <m1@x> <m0@x>
Content-Type: multipart/alternative; boundary="BB"

--BB
Content-Type: text/plain

plain part
--
sig
--BB
Content-Type: text/html

<p>html</p>
--BB--

From c@z Mon Jan 1
From: cy@z.org
Subject:

"""


def test_mbox(spark, tmp_path):
    path = tmp_path / "all.mbox"
    path.write_text(MBOX)
    for found in (mbox.read(spark, str(path)), mbox.ingest_text(spark, MBOX)):
        assert rows(found.messages, "sender", "text", "channel", "thread_id") == [("Ann Lee", "Hi all", "<m1@x>", "<m1@x>"), ("bob@y.org", "plain part", "<m1@x>", "<m1@x>")]
        assert rows(found.messages, "ts") == [(datetime(2024, 1, 1, 10),), (datetime(1970, 1, 1),)]
        assert rows(found.channels, "name", "channel_type") == [("<m1@x>", "group")]
        assert {r.name: r.aliases for r in found.people.collect()} == {"Ann Lee": ["ann@x.org"], "Bob": [], "cy@z.org": [], "bob@y.org": ["bob@y.org"], "ann@x.org": []}
    assert mbox.read(spark, str(path), ("ANN@x.org",)).messages.count() == 2 and mbox.read(spark, str(path), ("q@q.q",)).messages.count() == 0
    assert rows(mbox.read(spark, str(path), channel_from="subject").channels, "name") == [("plän",)]


def test_mail_texts():
    assert email_text.decode_words("=?utf-8?Q?a_=C3=A4?=") == "a Ã¤"
    assert email_text.addresses('"Lee, Ann" <a@x.org>, b@y.org', strict=True) == [("Lee, Ann", "a@x.org"), ("", "b@y.org")]
    assert email_text.address("Bo (bo@x.org) <bo@x.org>", strict=True) == ("Bo", "bo@x.org")
    coded = base64.b64encode(("words of a letter " * 30).encode()).decode()
    body = "\n".join(coded[i : i + 60] for i in range(0, len(coded), 60))
    assert email_text.server_body(body).startswith("words of a letter")
    assert email_text.server_body("a\n> q\nb\nOn Monday X wrote:\nc") == "a\nb" and email_text.server_body(None) == ""
    assert email_text.server_body("x\n--abcdefghijklmnopqrstuv\nContent-Type: text/plain") == ""
    assert email_text.server_body("<p>a &copy; b</p><li>c</li>") == "a   b\n\nc" and len(email_text.server_body("y" * 9000)) == 5000
    assert email_text.mbox_body("YWJj", "text/plain; base64") == "abc" and email_text.mbox_body("a=\nb=41", "quoted-printable") == "abA"


def test_gmail_assembly(spark):
    sign = "\nAnn Lee\nDirector of Kayaks\nhttp kayak org"
    me, bob = ("Ann", "me@x.org"), ("Bob Ray", "bob@y.org")
    mails = [
        (0, "1", *me, [bob], [("", "cy@z.org")], "Re: Trip", 1_000_000, "see you there" + sign, "<a>", []),
        (1, "2", *bob, [me], [], "Re: Trip", 2_000_000, "fine", "<b>", ["<a>"]),
        (2, "3", *me, [("bob", "b2@y.org")], [], "Lunch", 3_000_000, "at noon today" + sign, "<c>", []),
        (3, "4", *me, [bob], [], "Hills", 4_000_000, "up we go" + sign, "<d>", []),
        (4, "5", "GitHub", "noreply@github.com", [me], [], "Trip", 5_000_000, "spam", "<e>", ["<a>"]),
        (5, "6", *bob, [me], [], "Not mine", 6_000_000, "x", "<f>", []),
        (6, "7", *me, [bob], [], "Invoice 7", 7_000_000, "pay" + sign, "<g>", []),
    ]
    found = gmail.assemble(spark.createDataFrame(mails, gmail.RAW), "ME@x.org")
    said = {(r.channel, r.sender, r.text) for r in found.messages.where("not participant_only").collect()}
    assert said == {("Trip", "Ann", "see you there"), ("Trip", "Bob Ray", "fine"), ("Lunch", "Ann", "at noon today"), ("Hills", "Ann", "up we go")}
    there = {(r.channel, r.sender) for r in found.messages.where("participant_only").collect()}
    assert there == {("Trip", "Bob Ray"), ("Trip", "cy@z.org"), ("Lunch", "Bob Ray"), ("Hills", "Bob Ray")}
    assert {r.name: sorted(r.aliases) for r in found.people.collect()} == {"Ann": ["me@x.org"], "Bob Ray": ["b2@y.org", "bob@y.org"], "cy@z.org": ["cy@z.org"]}
    assert {r.name: r.channel_type for r in found.channels.collect()} == {"Trip": "group", "Lunch": "dm", "Hills": "dm"}


def test_raw_mails_from_a_connection(spark):
    data = b"From: Ann <me@x.org>\r\nTo: Bob <bob@y.org>\r\nSubject: Trip\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMessage-ID: <a>\r\n\r\nhello\r\n"
    found = gmail.read(spark, "me@x.org", "", connect=lambda user, password: iter([("1", data)]))
    assert [(r.sender, r.text) for r in found.messages.orderBy("seq").collect()] == [("Ann", "hello"), ("Bob", "")]


def test_command_line(spark, tmp_path, capsys):
    slack_export(tmp_path / "export")
    (tmp_path / "chat.txt").write_text(CHAT, encoding="utf-8")
    run = lambda *a: main(["--root", str(tmp_path / "index"), *a], spark)
    assert run("ingest", str(tmp_path / "export")) == 0 and run("merge", str(tmp_path / "chat.txt")) == 0
    assert run("people") == 0 and "person:Ann Lee" in capsys.readouterr().out
    assert run("person", "nobody") == 1 and run("traverse", "channel:general") == 0 and run("stats") == 0
    assert ingest(spark, str(tmp_path / "chat.txt")).messages.count() == 4
