"""Command line: ``python -m colloquy.cli --root DIR COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .index import ConversationIndex


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="colloquy")
    p.add_argument("--root", default=".colloquy")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "merge", "reindex"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?" if name == "reindex" else None)
        c.add_argument("--format")
        c.add_argument("--me", action="append", default=[])
    sub.add_parser("query").add_argument("text")
    for name in ("people", "channels", "hot"):
        sub.add_parser(name).add_argument("--limit", type=int, default=20)
    c = sub.add_parser("clusters")
    c.add_argument("--channel")
    c.add_argument("--limit", type=int, default=20)
    sub.add_parser("person").add_argument("name")
    c = sub.add_parser("traverse")
    c.add_argument("node")
    c.add_argument("--hops", type=int, default=2)
    c = sub.add_parser("annotate")
    c.add_argument("node")
    for name in ("--type", "--text", "--by", "--entity"):
        c.add_argument(name)
    c = sub.add_parser("enrich")
    c.add_argument("--limit", type=int, default=50)
    c.add_argument("--force", action="store_true")
    sub.add_parser("export").add_argument("path")
    sub.add_parser("stats")
    sub.add_parser("dedup")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    index = ConversationIndex(spark or SparkSession.builder.appName("colloquy").getOrCreate(), a.root)
    short = dict(n=20, truncate=80)
    if a.command in ("ingest", "merge", "reindex"):
        index.set_my_emails(a.me)
        found = getattr(index, a.command)(a.path, a.format)
        print(found) if isinstance(found, dict) else found.show()
    elif a.command == "query":
        index.query(a.text).select("id", "type", "name", "search_score").show(**short)
    elif a.command in ("people", "channels"):
        getattr(index, a.command)(a.limit).select("id", "name", "pagerank").show(**short)
    elif a.command == "hot":
        index.hot(a.limit).select("id", "type", "heat").show(**short)
    elif a.command == "clusters":
        index.clusters(a.channel, a.limit).select("id", "channel", "start_ts", "message_count", "pagerank").show(**short)
    elif a.command == "person":
        found = index.person(a.name)
        if found is None:
            print("not found")
            return 1
        print({k: found[k] for k in ("id", "name", "pagerank", "cluster_count")})
        for part in ("channels", "interactions", "topics"):
            found[part].show(**short)
    elif a.command == "traverse":
        found = index.traverse(a.node, a.hops)
        if found is None:
            print("not found")
            return 1
        found.select("depth", "id", "type", "parent").show(**short)
    elif a.command == "annotate":
        done = index.annotate(a.node, type=a.type, text=a.text, by=a.by, target_entity=a.entity)
        print("noted" if done else "not found")
        return int(not done)
    elif a.command == "enrich":
        print(index.enrich(limit=a.limit, force=a.force))
    elif a.command == "export":
        index.export_viz(a.path)
    elif a.command == "dedup":
        print(index.dedup_entities())
    else:
        index.stats().show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
