"""Text macros: definitions in files, expanded in a query before it is parsed.

    define(NAME, body)

A body goes up to the parenthesis that closes its definition; $1, $2 ... in it, in phrases too,
stand for the arguments of NAME(a, b). What an expansion gives is expanded again. Lines that
begin with # are comments, unless `changecom` has come before. Nothing is run to expand macros.
"""

from __future__ import annotations

import re

#: Expansions of one query, beyond which a macro is taken to define itself.
MOST = 10_000
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[A-Za-z_][A-Za-z_0-9]*|.', re.DOTALL)


class MacroError(ValueError):
    pass


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """(arguments, place after them) of the list whose opening parenthesis is before `at`."""
    out, depth, now = [], 0, ""
    while at < len(text):
        token = _TOKEN.match(text, at)[0]
        at += len(token)
        if token == ")" and depth == 0:
            return [*out, now.strip()], at
        depth += (token in "([") - (token in ")]")
        if token == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += token
    raise MacroError("a list of arguments isn't closed")


def read_macros(text: str) -> dict[str, str]:
    """name -> body of the definitions of a macro file; a later definition replaces an earlier one."""
    out: dict[str, str] = {}
    at, comments = 0, True
    while at < len(text):
        if comments and text[at] == "#":
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            continue
        token = _TOKEN.match(text, at)[0]
        at += len(token)
        if token == "changecom":
            comments = False
        elif token == "define":
            if text[at : at + 1] != "(":
                raise MacroError("define needs a name and a body")
            parts, at = _arguments(text, at + 1)
            if len(parts) < 2 or not re.fullmatch(r"[A-Za-z_][A-Za-z_0-9]*", parts[0]):
                raise MacroError(f"{parts[0]!r} can't be defined")
            out[parts[0]] = ",".join(parts[1:])
    return out


def load_macros(*paths: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            out |= read_macros(f.read())
    return out


def expand(query: str, macros: dict[str, str]) -> str:
    """The query with all macros of the table expanded."""
    out, todo, left = [], query, MOST
    while todo:
        token = _TOKEN.match(todo)[0]
        todo = todo[len(token) :]
        if token not in macros:
            out.append(token)
            continue
        left -= 1
        if left < 0:
            raise MacroError(f"{token} expands without end")
        args: list[str] = []
        if todo.startswith("("):
            args, at = _arguments(todo, 1)
            todo = todo[at:]
        body = re.sub(r"\$([1-9])", lambda m, args=args: args[int(m[1]) - 1] if int(m[1]) <= len(args) else "", macros[token])
        todo = body + todo
    return "".join(out)
