"""Commands: python -m lorescape.cli COMMAND. Each is a method of the engine, its rows shown as lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescape.engine import Engine
from lorescape.errors import LoreError
from lorescape.operators import sessions, usage, vault
from lorescape.sources import config, console, json_files, vault_files
from lorescape.sources.embedding import described, loaded


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorescape")
    p.add_argument("--warehouse")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("reindex", "watch"):
        sub.add_parser(name).add_argument("root")
    for name in ("embed", "doctor"):
        sub.add_parser(name)
    for name, limit in (("search", 5), ("ask-context", 3)):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--limit", type=int, choices=range(1, 21), default=limit, metavar="1..20")
        s.add_argument("--tag", action="append", default=[])
        s.add_argument("--project")
        s.add_argument("--min-score", type=float, default=0.0)
        s.add_argument("--usage-weight", type=float, default=0.3 if name == "ask-context" else 0.0)
    for name in ("show", "links"):
        sub.add_parser(name).add_argument("doc_id", type=int)
    sub.add_parser("usage").add_argument("--limit", type=int, default=20)
    sub.add_parser("hook-stats").add_argument("glob")
    imported = sub.add_parser("vault-import")
    imported.add_argument("source", nargs="+", help="slug=folder")
    imported.add_argument("--apply", action="store_true")
    sub.add_parser("vault-audit").add_argument("root")
    return p


def lines(df: DataFrame, column: str = "line") -> None:
    for r in df.collect():
        print(r[column])


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    settings = config.embedding()
    e = Engine(spark, config.warehouse(args.warehouse), loaded(settings), settings.model if settings else "")
    match args.command:
        case "reindex":
            done = e.reindex(args.root).first()
            print(*(f"{v} {k}" for k, v in done.asDict().items()), sep=", ")
            for r in e.failures(args.root).collect():
                print(f"{r['path']}: {r['reason']}", file=sys.stderr)
            return int(done["failed"] > 0)
        case "watch":
            from lorescape.streaming.watch import Watcher

            Watcher(spark, args.root, lambda changes: (changes.show(truncate=False), e.follow(args.root, changes))).start().awaitTermination()
        case "embed":
            done = e.refresh_embeddings()
            print("not configured" if done is None else done.first().asDict())
        case "doctor":
            e.doctor().show(truncate=False)
            print(described(settings))
        case "search":
            lines(console.search_lines(e.search(args.query, args.limit, args.min_score, args.usage_weight, args.tag, args.project)))
        case "ask-context":
            lines(console.context_block(e.ask_context(args.query, args.limit, args.usage_weight, tags=args.tag, project=args.project or config.project(), min_score=args.min_score)), "context")
        case "show":
            lines(e.document(args.doc_id), "body")
        case "links":
            lines(console.link_lines(e.outgoing(args.doc_id), e.backlinks(args.doc_id), e.table("documents")).orderBy(F.desc("kind"), "place"))
        case "usage":
            shown = console.usage_split_lines(usage.split_lists(e.usage_report(), args.limit))
            for kind, title in (("retrieved", "Retrieved"), ("never", "Never retrieved")):
                print(title)
                lines(shown.where(F.col("kind") == kind).orderBy("place"))
        case "hook-stats":
            states = json_files.session_states(spark, args.glob).selectExpr("session_id", "dedup_hits", "saved_chars", "cast(floor(saved_chars / 3.5) as long) saved_tokens")
            sessions.shown(states).show()
            sessions.totals(states).show()
        case "vault-import":
            for name in vault_files.recover(str(config.home())):
                print("finished", name)
            entries = vault_files.plan(spark, str(config.home()), [vault.parse_source(s) for s in args.source])
            vault.action_counts(entries).show()
            if args.apply:
                print(vault_files.apply(entries, str(config.home())))
        case "vault-audit":
            from lorescape.sources.markdown import files

            lines(console.audit_lines(vault.audit(e.table("documents"), e.edges(), files(spark, args.root), args.root)))
    return 0


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lorescape").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, args)
    except LoreError as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
