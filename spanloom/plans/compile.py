"""Expressions to DataFrames.

What operators.local knows is evaluated in the one pass over the texts: a whole query without a
shuffle, or else its largest such parts, whose results are shuffled once by document. Equal
sub-expressions are compiled once. Without that (an index, ids that several documents share) all
phrases and classes of a query are found in one pass; operators of two sets shuffle their union
again (see Compiler.run). A large sub-expression that is used repeatedly, or a large query that
has such, is written as a table, so that it isn't run again for every use.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..model import COLS, E, S
from ..operators import contain, leaves, local, pair, sets
from ..sources.shared import materialise
from .ast import BARE, NAMED, Node, rewrite, walk

#: How often an operator's plan has its operands in it, where that is not once.
TIMES = {"parenting": (2, 1), "childrening": (2, 1)}
#: Operators in the plan of a sub-expression from which on it is a table, if it is used repeatedly.
LARGE = 24
LEAVES = ("phrase", "class", "list", *BARE, *NAMED)


@dataclass
class Compiler:
    docs: DataFrame
    ignore_case: bool = False
    index: object = None
    word_chars: str = markup.WORD_CHARS
    done: dict = field(default_factory=dict)
    scanned: DataFrame | None = None
    patterns: list = field(default_factory=list)
    marks: DataFrame | None = None
    uses: Counter = field(default_factory=Counter)
    weights: dict = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)

    def run(self, node: Node) -> DataFrame:
        # Unions that keep their inputs' partitioning (new in Spark 4.1) go wrong when adaptive
        # execution coalesces those inputs differently: joins above fail or miss partners.
        self.docs.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
        node = rewrite(node)
        for n in set(walk(node)):
            for a, times in _operands(n):
                self.uses[a] += times
        if self.index is None and any(local.known(n) and n.op not in ("start", "end", "chars", "list", "file") for n in walk(node)) and not self._ids_repeat(node):
            return self._local(node)
        self.patterns = sorted({(n.op, n.args[0]) for n in walk(node) if n.op in ("phrase", "class")})
        if self.patterns:
            self.scanned = leaves.scan(self.docs, self.patterns, self.ignore_case)
            if any(n.op not in LEAVES and n.op != "or" for n in walk(node)):
                self.scanned = self.scanned.repartition("doc_id")
        return self.compile(node)

    def _ids_repeat(self, node: Node) -> bool:
        """Whether documents share an id, so that operators take regions of several texts as those of one document."""
        if all(n.op in LEAVES for n in walk(node)):
            return False
        return bool(self.docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())

    def _local(self, node: Node) -> DataFrame:
        if local.known(node):
            out = local.evaluate(self.docs, node, self.ignore_case, self.word_chars)
            nodes = list(walk(node))
            if len(nodes) > LARGE and len(set(nodes)) < len(nodes):
                out = materialise(out, "regions")
                self.tables.append(out.scratch)
            return out
        parts = list(dict.fromkeys(_known_parts(node)))
        found = local.evaluate_all(self.docs, parts, self.ignore_case, self.word_chars).repartition("doc_id")
        for k, part in enumerate(parts):
            self.done[part], self.weights[part] = leaves.hits_of(found, k), 1
        return self.compile(node)

    def compile(self, n: Node) -> DataFrame:
        if n not in self.done:
            self.done[n] = self._compile(n)
            self.weights[n] = 1 + sum(times * self.weights.get(a, 1) for a, times in _operands(n))
            if self.weights[n] > LARGE and self.uses[n] > 1:
                self.done[n] = materialise(self.done[n], "regions")
                self.tables.append(self.done[n].scratch)
                self.weights[n] = 1
        return self.done[n]

    def _markup(self) -> DataFrame:
        if self.marks is None:
            self.marks = markup.scan_tags(self.docs)
        return self.marks

    def _compile(self, n: Node) -> DataFrame:
        op, args = n.op, n.args
        if op in ("phrase", "class"):
            return leaves.hits_of(self.scanned, self.patterns.index((op, args[0])))
        if op in ("start", "end", "chars"):
            return getattr(leaves, op)(self.docs)
        if op == "list":
            return leaves.constant(self.docs, args)
        if op == "file":
            return leaves.files(self.docs, args[0])
        if op in ("stag", "etag", "word", "elements") and self.index is not None:
            return self.index.leaf(op, *args)
        if op in ("stag", "etag"):
            return markup.tags(self._markup(), op, args[0])
        if op == "elements":
            return markup.elements(self._markup())
        if op == "word":
            return markup.words_like(self.docs, args[0], self.ignore_case, self.word_chars)
        if op == "in_run":
            # In a run of n characters: shorter than n and inside the text, which has such a run.
            n_chars, a = args
            long = self.docs.where(F.length("text") >= n_chars).select("doc_id", F.length("text").alias("n"))
            return self.compile(a).where(E() - S() + 1 < n_chars).join(long, "doc_id").where(E() < F.col("n")).select(*COLS)
        sub = [self.compile(a) for a in args if isinstance(a, Node)]
        if op in ("in", "not in"):
            return contain.within(*sub, negate=op != "in")
        if op in ("containing", "not containing"):
            return contain.containing(*sub, negate=op != "containing")
        if op in ("equal", "not equal"):
            return contain.equal(*sub, negate=op != "equal")
        if op in ("inner", "outer", "parenting", "childrening"):
            return getattr(contain, op)(*sub)
        if op in ("near", "before", "nth_in"):
            return getattr(contain, op)(*sub, args[2])
        if op == "or":
            return sets.union(*[self.compile(x) for x in _flat(n)])
        if op in ("concat", "extracting"):
            return getattr(sets, op)(*sub)
        if op in ("join", "first_bytes", "last_bytes", "shorter"):
            return getattr(sets, "join_n" if op == "join" else op)(*sub, args[0])
        if op in pair._ENDS:
            return pair.pair(*sub, op)
        if "quote" in op:
            return pair.quote(*sub, skip_left=op.startswith("_"), skip_right=op.endswith("_"))
        raise ValueError(f"unknown operator {op}")


def _known_parts(n: Node) -> list[Node]:
    """The largest parts of an expression that operators.local evaluates."""
    return [n] if local.known(n) else [x for a in n.args if isinstance(a, Node) for x in _known_parts(a)]


def _operands(n: Node) -> list[tuple[Node, int]]:
    nodes = [a for a in n.args if isinstance(a, Node)]
    return list(zip(nodes, TIMES.get(n.op, (1,) * len(nodes)), strict=True))


def _flat(n: Node) -> list[Node]:
    """Operands of a union of unions, so that duplicates are removed once."""
    return [y for a in n.args for y in (_flat(a) if a.op == "or" else [a])]
