"""Expressions over region sets.

Nodes are immutable and compare by structure, so equal sub-expressions are one node to the
compiler. Methods build expressions from Python:
``phrase("<p>").to(phrase("</p>")).containing(word("spark"))``.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Operators between two sets, as they are written.
BINARY = {"in": "within", "not in": "within", "containing": "containing", "not containing": "containing", "equal": "equal", "not equal": "equal", "or": "union", "extracting": "extracting", "..": "pair", "._": "pair", "_.": "pair", "__": "pair", "quote": "quote", "_quote": "quote", "quote_": "quote", "_quote_": "quote", "parenting": "parenting", "childrening": "childrening", "near": "near", "before": "before"}
#: Functions of one set; those of NUMBERED take a number first.
UNARY = ("inner", "outer", "concat")
NUMBERED = ("join", "first_bytes", "last_bytes", "shorter")
NAMED = ("stag", "etag", "word", "file")
BARE = ("start", "end", "chars", "elements")


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()

    def _with(self, op, other, *more):
        return Node(op, (self, as_node(other), *more))

    def within(self, b):
        return self._with("in", b)

    def not_in(self, b):
        return self._with("not in", b)

    def in_or_equal(self, b):
        """Containment that equal regions satisfy too."""
        return self.within(b).or_(self.equal(b))

    def containing(self, b):
        return self._with("containing", b)

    def not_containing(self, b):
        return self._with("not containing", b)

    def equal(self, b):
        return self._with("equal", b)

    def not_equal(self, b):
        return self._with("not equal", b)

    def or_(self, b):
        return self._with("or", b)

    def extracting(self, b):
        return self._with("extracting", b)

    def to(self, b, skip_left=False, skip_right=False):
        return self._with({(0, 0): "..", (0, 1): "._", (1, 0): "_.", (1, 1): "__"}[bool(skip_left), bool(skip_right)], b)

    def quote(self, b, skip_left=False, skip_right=False):
        return self._with("_" * bool(skip_left) + "quote" + "_" * bool(skip_right), b)

    def parenting(self, b):
        return self._with("parenting", b)

    def childrening(self, b):
        return self._with("childrening", b)

    def near(self, b, n):
        return self._with("near", b, int(n))

    def before(self, b, n):
        return self._with("before", b, int(n))

    def nth_in(self, b, n):
        return self._with("nth_in", b, int(n))

    def inner(self):
        return Node("inner", (self,))

    def outer(self):
        return Node("outer", (self,))

    def concat(self):
        return Node("concat", (self,))

    def join(self, n):
        return Node("join", (int(n), self))

    def first_bytes(self, n):
        return Node("first_bytes", (int(n), self))

    def last_bytes(self, n):
        return Node("last_bytes", (int(n), self))

    def shorter(self, n):
        return Node("shorter", (int(n), self))

    def __str__(self):
        return unparse(self)


def as_node(x) -> Node:
    return x if isinstance(x, Node) else phrase(x)


def phrase(text: str) -> Node:
    if not text:
        raise ValueError("an empty phrase matches nothing")
    return Node("phrase", (text,))


def char_class(letters: str) -> Node:
    """Single characters out of a set: one pattern instead of a union of phrases."""
    return Node("class", ("".join(sorted(set(letters))),))


def constant(pairs) -> Node:
    from ..operators.leaves import check_list

    return Node("list", check_list(pairs))


def stag(name="*") -> Node:
    return Node("stag", (name,))


def etag(name="*") -> Node:
    return Node("etag", (name,))


def word(w) -> Node:
    return Node("word", (w,))


def file(name="*") -> Node:
    return Node("file", (name,))


start, end, chars, elements = (Node(x) for x in BARE)


def union(*nodes) -> Node:
    out = as_node(nodes[0])
    for n in nodes[1:]:
        out = out.or_(n)
    return out


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}


def quoted(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c, c) for c in text) + '"'


def unparse(n: Node, nested: bool = False) -> str:
    """Text that parses to the same expression."""
    if n.op == "phrase":
        return quoted(n.args[0])
    if n.op == "class":
        return f"chars_of({quoted(n.args[0])})"
    if n.op == "list":
        return "[" + " ".join(f"({s},{e})" for s, e in n.args) + "]"
    if n.op in BARE:
        return n.op
    if n.op in NAMED:
        return f"{n.op}({quoted(n.args[0])})"
    if n.op in UNARY:
        return f"{n.op}({unparse(n.args[0])})"
    if n.op in NUMBERED:
        return f"{n.op}({n.args[0]}, {unparse(n.args[1])})"
    if n.op == "nth_in":
        return f"nth_in({n.args[2]}, {unparse(n.args[0])}, {unparse(n.args[1])})"
    op = f"{n.op}({n.args[2]})" if len(n.args) > 2 else n.op
    left = unparse(n.args[0])
    text = f"{left} {op} {unparse(n.args[1], True)}"
    return f"({text})" if nested else text


def walk(n: Node):
    for a in n.args:
        if isinstance(a, Node):
            yield from walk(a)
    yield n


def rewrite(n: Node) -> Node:
    """Equivalent, cheaper forms.

    Unions of single characters become one class; a set compared with itself becomes inner or
    outer; being in a run of n characters becomes a test of length; doubled inner, outer and
    concat are single.
    """
    args = tuple(rewrite(a) if isinstance(a, Node) else a for a in n.args)
    n = Node(n.op, args)
    if n.op == "or":
        letters = [a.args[0] for a in args if a.op == "class" or a.op == "phrase" and len(a.args[0]) == 1]
        if len(letters) == 2:
            return char_class("".join(letters))
        if args[0] == args[1]:
            return args[0]
    if n.op == "not containing" and args[0] == args[1]:
        return Node("inner", args[:1])
    if n.op == "not in" and args[0] == args[1]:
        return Node("outer", args[:1])
    if n.op in ("inner", "outer", "concat") and args[0].op == n.op:
        return args[0]
    if n.op == "in" and args[1].op == "join" and args[1].args[1] == chars:
        return Node("in_run", (args[1].args[0], args[0]))
    return n
