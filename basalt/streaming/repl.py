"""Interactive statements: `;` ends one, and may not be inside quotes."""
from __future__ import annotations

import sys
from typing import TextIO

HELP = "Small SQL shell\n.help           show this help\n.quit           exit\nStatements end with ';'.\n"


def split_statements(text: str) -> tuple[list[str], str]:
    """Finished statements, and the rest of the text."""
    done, start, quoted = [], 0, False
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif ch == ";" and not quoted:
            done.append(text[start:i].strip())
            start = i + 1
    return [s for s in done if s], text[start:].strip() if done else text


def run(execute, source: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    """Feeds statements to execute(sql) -> text or lines of it until .quit or the end; 1 if that cuts a statement off."""
    out.write(HELP)
    pending = ""
    while True:
        out.write("...> " if pending else "sql> ")
        out.flush()
        line = source.readline()
        if not line:
            if pending:
                err.write("repl error: unterminated statement before EOF\n")
            out.write("\n")
            return 1 if pending else 0
        line = line.rstrip("\n")
        word = line.strip()
        if not pending and not word:
            continue
        if not pending and word.startswith("."):
            if word == ".quit":
                return 0
            if word == ".help":
                out.write(HELP)
            else:
                err.write(f"repl error: unknown command: {word}\n")
            continue
        statements, pending = split_statements(f"{pending}\n{line}" if pending else line)
        for sql in statements:
            try:
                out.writelines(execute(sql))
            except (ValueError, RuntimeError) as e:
                err.write(f"repl error: {e}\n")
