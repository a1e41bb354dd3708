"""``python -m mycelia.cli ingest PATH | query TEXT | stats``, over a graph stored under ``--store``."""

from __future__ import annotations

import argparse
import os
import sys
import time

from mycelia.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mycelia")
    parser.add_argument("--store", default="graph-store")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("path")
    commands.add_parser("query").add_argument("text")
    commands.add_parser("stats")
    args = parser.parse_args(argv)
    if args.command == "ingest" and not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return 1

    from mycelia.api import ConceptGraph
    from mycelia.operators.graph import build
    from mycelia.plans import store
    from mycelia.sources.files import outcomes, parse, read_folder, sentences_in_order

    spark = local_session()
    if args.command == "ingest":
        files = read_folder(spark, args.path)
        elements = parse(files).persist()
        store.save(build(sentences_in_order(elements)), args.store, store.new_module(spark, args.store, args.path))
        outcomes(files, elements).groupBy("status").count().show()
        return 0
    names = [r.module for r in store.modules(spark, args.store).collect()]
    graph = ConceptGraph(spark, store.mount(spark, args.store, names))
    if args.command == "stats":
        for name, value in graph.get_stats().items():
            print(f"{name}: {value}")
    else:
        began = time.time()
        print(graph.run_query(args.text))
        print(f"{time.time() - began:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
