"""python -m weftline: the engine from a shell. Exit codes are those of EXIT."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

EXIT = {"ok": 0, "error": 1, "cycle": 2, "stale": 3, "no_index": 4, "doctor": 5, "enrich": 6, "export": 7, "lint": 8}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    p.add_argument("--repo", default=".")
    p.add_argument("--store", help="folder of the store; .weftline in the repository by default")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub_ := sub.add_parser(name), [sub_.add_argument(*a, **k) for a, k in args]][0]
    one = lambda *a, **k: (a, k)
    add("init")
    add("sync", one("--revision"))
    add("compact")
    add("search", one("text"), one("--limit", type=int, default=20))
    add("query", one("text"), one("--depth", type=int, default=3), one("--depth-first", action="store_true"))
    add("trace", one("target"), one("--depth", type=int, default=3))
    add("affected", one("target"), one("--depth", type=int, default=2))
    add("path", one("a"), one("b"))
    add("explain", one("target"))
    add("blame", one("target"))
    add("diff")
    add("report", one("--format", choices=("md", "json"), default="md"), one("--max-tokens", type=int), one("--top", type=int, default=10), one("--fail-on-cycle", action="store_true"))
    add("export", one("--format", choices=("json", "html", "tree"), default="json"), one("--out", required=True), one("--path"), one("--kind", action="append"), one("--check", action="store_true"))
    add("save-result", one("--question", required=True), one("--outcome", required=True), one("--nodes", nargs="+", default=[]))
    add("reflect")
    add("annotate", one("target"), one("--label"), one("--note"), one("--relation"), one("--to"), one("--outcome"), one("--author", default="user"))
    add("lint")
    add("bench", one("--corpus", required=True))
    add("check-update")
    add("doctor")
    return p


def table(df) -> None:
    names = df.columns
    for r in df.collect():
        print("\t".join("" if r[n] is None else str(r[n]) for n in names))


def run(args: argparse.Namespace, spark=None) -> int:
    store = args.store or os.path.join(args.repo, ".weftline")
    if args.command == "check-update" and not os.path.exists(f"{store}/manifest.json"):
        print("no-index")
        return EXIT["no_index"]
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("weftline").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    from .api import Engine
    from .operators import annotate, export, memory

    e = Engine(spark, store, args.repo)
    notes = f"{store}/annotations.jsonl"
    match args.command:
        case "init":
            print(store)
        case "sync":
            print(f"version {e.sync(args.revision)}")
        case "compact":
            print(f"removed {len(e.compact())}")
        case "search":
            table(e.search(args.text, args.limit))
        case "query":
            table(e.query(args.text, args.depth, depth_first=args.depth_first))
        case "trace":
            table(e.trace(args.target, args.depth))
        case "affected":
            table(e.affected(args.target, args.depth))
        case "path":
            table(e.path(args.a, args.b).orderBy("hop"))
        case "explain":
            table(e.describe(args.target).orderBy("section", "place"))
        case "blame":
            table(e.blame(args.target).orderBy("start"))
            table(e.changed_with(args.target).orderBy("path"))
        case "diff":
            table(e.diff())
        case "report":
            found = e.report(args.top)
            print(json.dumps(found, indent=2, ensure_ascii=False) if args.format == "json" else export.render(found, args.max_tokens))
            if args.fail_on_cycle and found["cycles"]:
                return EXIT["cycle"]
        case "export":
            nodes = export.selected(e.nodes, args.path, args.kind)
            if args.check:
                fresh = export.is_fresh(nodes, e.edges, args.out)
                print("up-to-date" if fresh else "out of date")
                return EXIT["ok" if fresh else "export"]
            if args.format == "json":
                export.to_json(nodes, e.edges, args.out)
            elif args.format == "html":
                export.to_html(nodes, e.edges, args.out)
            else:
                export.to_tree(nodes, args.out)
        case "save-result":
            e.save_result(args.question, args.outcome, args.nodes, int(time.time()))
        case "reflect":
            table(e.reflect(int(time.time())).orderBy("node"))
        case "annotate":
            target, to = e.resolve(args.target), args.to and e.resolve(args.to)
            seen = e.nodes.where(f"id = '{target}'").first()["source_hash"]
            annotate.add(notes, annotate.make(spark, target, int(time.time()), args.label, args.note, args.relation, to, args.outcome, args.author, source_hash=seen))
        case "lint":
            found = memory.annotation_lint(memory.annotation_state(annotate.frame(spark, notes), e.nodes)).orderBy("id", "problem")
            table(found)
            return EXIT["lint"] if found.count() else EXIT["ok"]
        case "bench":
            table(e.bench(args.corpus).orderBy("query_id"))
        case "check-update":
            fresh = e.is_current()
            print("up-to-date" if fresh else "stale: files differ from the index")
            return EXIT["ok" if fresh else "stale"]
        case "doctor":
            checks = {"repository": os.path.isdir(f"{args.repo}/.git"), "index": e.store.version() > 0, "annotations": not annotate.load(notes)[1]}
            for name, good in checks.items():
                print(f"{'ok' if good else 'FAIL'}\t{name}")
            return EXIT["ok"] if all(checks.values()) else EXIT["doctor"]
    return EXIT["ok"]


def main() -> int:
    try:
        return run(parser().parse_args())
    except (ValueError, LookupError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return EXIT["error"]


if __name__ == "__main__":
    sys.exit(main())
