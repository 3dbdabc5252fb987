"""A small command line: ingest, search, ask, audit, status, gc, export, verify."""

from __future__ import annotations

import argparse
import json
import sys

from lodespark.config import Config
from lodespark.errors import EngineError
from lodespark.plans.engine import Engine
from lodespark.plans.generations import export_bundle, verify_bundle
from lodespark.session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodespark", description=__doc__)
    parser.add_argument("--store", default=".lodespark")
    parser.add_argument("--config", help="a JSON file of settings")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "audit", "preview"):
        sub.add_parser(name).add_argument("root")
    for name in ("search", "ask"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--top-k", type=int)
        p.add_argument("--include", action="append")
        p.add_argument("--exclude", action="append")
    for name in ("status", "gc", "sources", "compact", "rollback"):
        sub.add_parser(name)
    for name in ("export", "verify"):
        sub.add_parser(name).add_argument("target")
    own = parser.parse_args(args)
    config = Config.load(json.load(open(own.config, encoding="utf-8")) if own.config else {})
    spark = local_session()
    try:
        engine = Engine(spark, own.store, config)
        show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str, indent=2))
        rows = lambda df: show([r.asDict(True) for r in df.collect()])
        query = lambda: spark.createDataFrame([(1, own.query)], "query_id long, query string")
        match own.command:
            case "ingest":
                show(engine.ingest(own.root))
            case "audit":
                show(engine.audit(own.root))
            case "preview":
                rows(engine.preview(own.root))
            case "search":
                rows(engine.compact(engine.search(query(), own.top_k, own.include, own.exclude)).orderBy("rank"))
            case "ask":
                rows(engine.ask(query(), top_k=own.top_k, include=own.include, exclude=own.exclude))
            case "status":
                show(engine.status())
            case "gc":
                show(engine.store.collect_garbage())
            case "sources":
                rows(engine.sources())
            case "compact":
                show(engine.store.compact(config))
            case "rollback":
                show(engine.store.rollback())
            case "export":
                show(export_bundle(engine.store, own.target)["manifest"])
            case "verify":
                rows(verify_bundle(spark, own.target))
    except EngineError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
