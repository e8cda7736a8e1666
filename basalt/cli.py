"""Command line: python -m basalt <command> ...

Paths name a table by its base path; a trailing .tbl or .parquet is accepted and dropped.
"""
from __future__ import annotations

import argparse
import sys

from basalt.api import Engine
from basalt.streaming import repl, server


def _base(path: str) -> str:
    return path.removesuffix(".tbl").removesuffix(".parquet")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="basalt", description="Tables, scans and small SQL on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"create": ("columns",), "insert": ("values...",), "select-eq": ("col", "value"), "select-between": ("col", "lo", "hi"), "sum": ("col",), "flush": ()}.items():
        c = sub.add_parser(name)
        c.add_argument("path", type=_base)
        for a in args:
            c.add_argument(a.removesuffix("..."), type=int, nargs="+" if a.endswith("...") else None)
    sub.add_parser("query").add_argument("sql", nargs="+")
    sub.add_parser("repl")
    sub.add_parser("serve").add_argument("--port", type=int, default=7878)
    return p


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = _parser().parse_args(argv)
    e = engine or Engine()
    if a.command == "repl":
        return repl.run(e.sql_lines)
    if a.command == "serve":
        with server.make_server(lambda: Engine(e.spark).sql_lines, a.port) as s:
            print(f"listening on 127.0.0.1:{s.server_address[1]}", flush=True)
            s.serve_forever()
    try:
        if a.command == "query":
            sys.stdout.writelines(e.sql_lines(" ".join(a.sql)))
        elif a.command == "create":
            e.create_table(a.path, a.columns)
        elif a.command == "insert":
            print(e.insert(a.path, a.values))
        elif a.command == "select-eq":
            print(*e.scan_eq(a.path, a.col, a.value), sep="\n")
        elif a.command == "select-between":
            print(*e.scan_between(a.path, a.col, min(a.lo, a.hi), max(a.lo, a.hi)), sep="\n")
        elif a.command == "sum":
            print(e.sum(a.path, a.col))
        elif a.command == "flush":
            e.flush(a.path)
    except (ValueError, RuntimeError) as err:
        print(f"{a.command} error: {err}", file=sys.stderr)
        return 1
    return 0
