"""Command line: index, search, mcp, stats, analyze."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import __version__
from .config import RecallConfig


def session():
    """The Spark session of a command."""
    from .vault import default_session

    return default_session()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="memweft", description="Hybrid recall over directories of Markdown notes.")
    p.add_argument("--version", action="version", version=f"memweft {__version__}")
    sub = p.add_subparsers(dest="command")
    vault = argparse.ArgumentParser(add_help=False)
    vault.add_argument("--tenant", required=True, help="directory of notes")
    vault.add_argument("--half-life", type=float, default=0.0, help="half-life of scores in days, 0 for none")
    vault.add_argument("--mmr", type=float, default=0.7, help="weight of relevance against diversity, 1 for relevance alone")
    vault.add_argument("--recursive", action="store_true", help="include directories below")
    vault.add_argument("--strip-frontmatter", action="store_true", help="leave out a leading --- block")
    vault.add_argument("--ignore", action="append", default=[], metavar="GLOB", help="leave out paths that match; may be repeated")
    sub.add_parser("index", parents=[vault], help="bring the index up to date")
    search = sub.add_parser("search", parents=[vault], help="search the index as it is")
    search.add_argument("query")
    search.add_argument("-k", type=int, default=5)
    search.add_argument("--json", action="store_true")
    sub.add_parser("mcp", parents=[vault], help="run the tool server")
    sub.add_parser("stats", help="size of an index").add_argument("--tenant", required=True)
    report = sub.add_parser("analyze", help="report on the recall log")
    report.add_argument("--tenant", help="only this tenant")
    report.add_argument("--json", action="store_true")
    return p


def main(argv=None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.command:
        p.print_help()
        return 1
    if a.command == "analyze":
        return analyze(a.tenant, a.json)
    from .vault import Vault

    if a.command == "stats":
        s = Vault(a.tenant, spark=session()).stats()
        print(f"memweft: {s['files']} files, {s['chunks']} chunks indexed at {s['index']}")
        return 0
    config = RecallConfig(half_life_days=a.half_life, mmr_lambda=a.mmr, recursive=a.recursive, strip_frontmatter=a.strip_frontmatter, ignore_globs=tuple(a.ignore))
    if a.command == "mcp":
        from .server import serve

        serve(a.tenant, config, session())
    elif a.command == "index":
        print(json.dumps(Vault(a.tenant, config, session()).reindex()))
    else:
        hits = Vault(a.tenant, config, session()).search(a.query, a.k)
        if a.json:
            print(json.dumps(hits, indent=2))
        for h in [] if a.json else hits:
            print(f"  {h['score']:>8}  {h['file']}\n{'':12}{h['snippet'][:100]}")
    return 0


def analyze(tenant: str | None, as_json: bool, spark=None) -> int:
    """Print how well recall works, from the log."""
    from .operators import report
    from .sources.querylog import RecallLog, read_log
    path = RecallLog.configured().path
    if not path or not os.path.exists(path):
        print(f"No query log yet. Run some recalls first (log: {path or 'disabled'}).")
        return 0
    lines = report.recall_lines(read_log(spark or session(), path), os.path.basename(tenant.rstrip("/")) if tenant else None)
    one = report.overall(lines).first()
    if not one["recalls"]:
        print("No recall events match.")
        return 0
    tenants = [(r["tenant"], r["n"]) for r in report.busiest_tenants(lines).collect()]
    if as_json:
        print(json.dumps({**one.asDict(), "by_tenant": dict(tenants)}, indent=2))
        return 0
    print(f"memweft: recall effectiveness ({path})\n")
    empty = lines.where("empty").count()
    print(f"  recalls          {one['recalls']}\n  without hits     {empty} ({one['empty_rate']:.0%})")
    if one["latency_p50_ms"] is not None:
        p95 = one["latency_p95_ms"]
        if p95 is None:  # two values or fewer: the latest
            p95 = lines.where("latency_ms IS NOT NULL").orderBy("line_no", ascending=False).first()["latency_ms"]
        print(f"  latency p50/p95  {one['latency_p50_ms']:.0f} / {p95:.0f} ms")
    if one["avg_top_score"] is not None:
        print(f"  mean top score   {one['avg_top_score']:.4f}")
    print("  by tenant        " + ", ".join(f"{t}: {n}" for t, n in tenants))
    misses = report.recent_misses(lines).collect()
    if misses:
        print("\n  latest queries without hits:\n" + "\n".join(f"    - {m['query']}" for m in misses))
    return 0


if __name__ == "__main__":
    sys.exit(main())
