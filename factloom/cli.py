"""Command line: ``python -m factloom ingest|extract|resolve|reconcile|status``."""

from __future__ import annotations

import argparse
import importlib

from .plans import pipeline, views
from .session import local_session
from .sources.clients import HashedEmbedder
from .sources.store import Store


def loaded(name: str):
    """An object named ``module:attribute``, called if it is a class."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    made = {name: commands.add_parser(name) for name in ("ingest", "extract", "resolve", "reconcile", "status")}
    for p in made.values():
        p.add_argument("--store", default="factloom-store")
    made["ingest"].add_argument("path")
    made["ingest"].add_argument("--first", type=int)
    made["ingest"].add_argument("--last", type=int)
    made["ingest"].add_argument("--parser", default="factloom.sources.pages:parse_plain")
    made["extract"].add_argument("--completer", required=True, help="module:attribute")
    made["resolve"].add_argument("--embedder", help="module:attribute")
    made["reconcile"].add_argument("--judge", help="module:attribute of a completer")
    args = parser.parse_args(argv)
    store = Store(local_session(), args.store)
    if args.command == "ingest":
        print(pipeline.ingest_path(store, args.path, loaded(args.parser), args.first, args.last))
    elif args.command == "extract":
        print({"facts": pipeline.extract(store, loaded(args.completer))})
    elif args.command == "resolve":
        print(pipeline.resolve(store, loaded(args.embedder) if args.embedder else HashedEmbedder()))
    elif args.command == "reconcile":
        counts = pipeline.reconcile_all(store)
        if args.judge:
            counts = pipeline.judge_all(store, HashedEmbedder(), loaded(args.judge))
        counts.orderBy("count", ascending=False).show(truncate=False)
    else:
        views.document_status(store.read("documents"), store.read("pages"), store.read("blocks")).show(truncate=False)
        views.totals(store.read("facts")).show()
        views.verdict_counts(store.read("verdicts")).show(truncate=False)
