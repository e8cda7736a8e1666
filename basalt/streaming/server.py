"""A line protocol on the loopback interface: a statement a line, a framed answer for each.

    OK\\n<tab-separated result>END\\n     ERR\\t<message>\\nEND\\n     BYE\\nEND\\n

Rows are sent as they are fetched; a result that fails after its first line is cut off: the connection closes without END.
"""
from __future__ import annotations

import itertools
import socketserver
from collections.abc import Iterable


def answer(execute, line: str) -> tuple[Iterable[str], bool]:
    """The framed answer in parts, and whether the client is done. execute(sql) gives text or lines of it; two
    lines are fetched first, so that a query that fails before its first row is answered with its error."""
    sql = line.strip()
    if not sql:
        return ["ERR\tempty request\nEND\n"], False
    if sql == ".quit":
        return ["BYE\nEND\n"], True
    try:
        rest = iter(execute(sql))
        first = list(itertools.islice(rest, 2))
    except (ValueError, RuntimeError) as e:
        return [f"ERR\t{str(e).splitlines()[0] if str(e) else type(e).__name__}\nEND\n"], False
    return itertools.chain(["OK\n"], first, rest, ["END\n"]), False


def make_server(new_session, port: int = 0) -> socketserver.TCPServer:
    """Serves clients one at a time on 127.0.0.1; new_session() gives each client its own execute(sql)."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            execute = new_session()
            for raw in self.rfile:
                parts, done = answer(execute, raw.decode("utf-8", "replace"))
                for part in parts:
                    self.wfile.write(part.encode())
                if done:
                    return

    class Server(socketserver.TCPServer):
        allow_reuse_address = True

    return Server(("127.0.0.1", port), Handler)
