"""The command line: ``python -m glyphtrail.cli --corpus DIR COMMAND``; every command prints one line or the rows that it is about."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import corpus as plans
from .settings import load_config
from .sources.corpus import STATUSES, Corpus
from .sources.files import html_report, write_jsonl

REPORT_COLUMNS = ["best_score", "matched_alias", "best_text", "support_count", "title", "timestamp_url", "evidence_text", "review_status", "reviewer_note"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphtrail")
    p.add_argument("--corpus", required=True)
    p.add_argument("--config")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        c = commands.add_parser(name)
        for o in options:
            c.add_argument(o[0], **(o[1] if len(o) > 1 else {}))

    scope = (("--scan-id", {"type": int}), ("--run-id", {"type": int}))
    add("query", ("--name",), ("--alias", {"action": "append", "default": []}), *scope)
    add("report", ("--out", {"required": True}), ("--query-id",), ("--clusters", {"action": "store_true"}), *scope)
    add("review", ("cluster", {"type": int}), ("query",), ("status", {"choices": STATUSES["reviews"]}), ("--note",))
    add("delete-source", ("source",))
    add("prune")
    add("totals")
    return p


def main(spark: SparkSession, arguments: list[str]) -> int:
    a = parser().parse_args(arguments)
    corpus = Corpus(spark, a.corpus)
    config = load_config(a.config) if a.config else None
    if a.command == "query":
        names = [a.name, *a.alias] if a.name else config.aliases if config else []
        if not names:
            print("a name is needed", file=sys.stderr)
            return 2
        print(plans.run_query(corpus, names[0], names[1:], a.scan_id, a.run_id, config.settings["matching"] if config else None))
    elif a.command == "report":
        hits = plans.hit_records(corpus, a.query_id, a.scan_id, a.run_id)
        write_jsonl(hits, f"{a.out}/hits.jsonl")
        corpus.write_text(f"{a.out}/index.html", html_report(hits, REPORT_COLUMNS, "Hits"))
        if a.clusters:
            write_jsonl(plans.cluster_records(corpus, a.scan_id, a.run_id), f"{a.out}/text_clusters.jsonl")
        print(a.out)
    elif a.command == "review":
        plans.review(corpus, a.cluster, a.query, a.status, a.note)
    elif a.command == "delete-source":
        print(plans.delete_source(corpus, a.source))
    elif a.command == "prune":
        print(plans.prune(corpus))
    else:
        from .operators.reports import totals

        print(json.dumps({r["name"]: r["n"] for r in totals({t: corpus.read(t) for t in ("videos", "video_scans", "text_clusters", "hits")}).collect()}))
    return 0


if __name__ == "__main__":
    sys.exit(main(SparkSession.builder.appName("glyphtrail").getOrCreate(), sys.argv[1:]))
