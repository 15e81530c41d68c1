"""Expressions as DuckDB SQL, written from the definitions: an independent oracle for plans.

Filters are EXISTS over all partners, coalescing and extraction work on single positions where
they can, and only pairing and quoting follow the same idea as the engine.
"""

from __future__ import annotations

from .ast import Node


def text(s: str) -> str:
    """A string literal; control characters are chr() calls."""
    parts, plain = [], ""
    for c in s:
        if c < " ":
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    return "(" + " || ".join([*parts, f"'{plain}'"]) + ")"


def _inside(x: str, y: str) -> str:
    return f"(({x}.s > {y}.s AND {x}.e <= {y}.e) OR ({x}.e < {y}.e AND {x}.s >= {y}.s))"


class Sql:
    """Builds a WITH clause of one table (d, s, e) a node."""

    def __init__(self, source: str):
        self.ctes = [f"docs AS ({source})"]
        self.names: dict[Node, str] = {}

    def query(self, n: Node) -> str:
        out = self.table(n)
        return "WITH RECURSIVE " + ",\n".join(self.ctes) + f"\nSELECT d AS doc_id, s::BIGINT AS start_pos, e::BIGINT AS end_pos FROM {out}"

    def add(self, body: str, name: str | None = None) -> str:
        name = name or f"t{len(self.ctes)}"
        self.ctes.append(f"{name} AS ({body})")
        return name

    def table(self, n: Node) -> str:
        if n not in self.names:
            self.names[n] = self.add(self.body(n))
        return self.names[n]

    def body(self, n: Node) -> str:
        op, args = n.op, n.args
        if op == "phrase":
            p, k = text(args[0]), len(args[0])
            # Every position at which the text goes on with the phrase, from the pieces between hits.
            if any(args[0].startswith(args[0][i:]) for i in range(1, k)):
                raise ValueError("phrases that overlap themselves need every position")
            t = f"SELECT d, i, sum(length(c) + {k}) OVER (PARTITION BY d ORDER BY i) - {k} AS s, n FROM (SELECT d, unnest(string_split(t, {p})) AS c, generate_subscripts(string_split(t, {p}), 1) AS i, len(string_split(t, {p})) AS n FROM docs WHERE t <> '')"
            return f"SELECT d, s, s + {k - 1} AS e FROM ({t}) WHERE i < n"
        if op == "class":
            return " UNION ALL ".join(f"SELECT * FROM {self.table(Node('phrase', (c,)))}" for c in args[0])
        if op in ("start", "end", "chars"):
            at = {"start": "0", "end": "length(t) - 1"}.get(op)
            return f"SELECT d, {at} AS s, {at} AS e FROM docs WHERE t <> ''" if at else "SELECT d, p AS s, p AS e FROM (SELECT d, unnest(range(length(t))) AS p FROM docs WHERE t <> '')"
        if op == "list":
            rows = ", ".join(f"({s}, {e})" for s, e in args)
            return f"SELECT d, s, e FROM docs, (VALUES {rows}) v(s, e)"
        if op == "file":
            return f"SELECT d, 0 AS s, length(t) - 1 AS e FROM docs WHERE t <> '' AND name LIKE {text(args[0].replace('*', '%'))}"
        if op == "word":
            rx = args[0]
            t = "SELECT d, unnest(regexp_extract_all(t, '[0-9A-Za-zÀ-ÖØ-öø-ɏ]+|[^0-9A-Za-zÀ-ÖØ-öø-ɏ]+')) AS c, generate_subscripts(regexp_extract_all(t, '[0-9A-Za-zÀ-ÖØ-öø-ɏ]+|[^0-9A-Za-zÀ-ÖØ-öø-ɏ]+'), 1) AS i FROM docs"
            same = f"starts_with(c, {text(rx[:-1])}) AND regexp_full_match(c, '[0-9A-Za-zÀ-ÖØ-öø-ɏ]+')" if rx.endswith("*") else f"c = {text(rx)}"
            return f"SELECT d, s, s + length(c) - 1 AS e FROM (SELECT *, sum(length(c)) OVER (PARTITION BY d ORDER BY i) - length(c) AS s FROM ({t})) WHERE {same}"
        a = next((self.table(x) for x in args if isinstance(x, Node)), None)
        b = self.table(args[1]) if len(args) > 1 and isinstance(args[0], Node) else None
        exists = lambda cond: f"EXISTS (SELECT 1 FROM {b} y WHERE y.d = x.d AND {cond})"
        if op in ("in", "not in"):
            return f"SELECT * FROM {a} x WHERE {'NOT ' * (op != 'in')}{exists(_inside('x', 'y'))}"
        if op in ("containing", "not containing"):
            return f"SELECT * FROM {a} x WHERE {'NOT ' * (op != 'containing')}{exists(_inside('y', 'x'))}"
        if op in ("equal", "not equal"):
            return f"SELECT * FROM {a} {'INTERSECT' if op == 'equal' else 'EXCEPT'} SELECT * FROM {b}"
        if op in ("inner", "outer"):
            b = a
            return f"SELECT * FROM {a} x WHERE NOT {exists(_inside('y', 'x') if op == 'inner' else _inside('x', 'y'))}"
        if op == "or":
            return f"SELECT * FROM {a} UNION SELECT * FROM {b}"
        if op == "near":
            return f"SELECT * FROM {a} x WHERE {exists(f'y.s - x.e - 1 <= {args[2]} AND x.s - y.e - 1 <= {args[2]}')}"
        if op == "before":
            return f"SELECT * FROM {a} x WHERE {exists(f'y.s - x.e - 1 BETWEEN 0 AND {args[2]}')}"
        if op == "parenting":
            return f"SELECT DISTINCT x.* FROM {a} x JOIN {b} y ON y.d = x.d AND {_inside('y', 'x')} WHERE NOT EXISTS (SELECT 1 FROM {a} m WHERE m.d = x.d AND {_inside('y', 'm')} AND {_inside('m', 'x')})"
        if op == "childrening":
            return f"SELECT DISTINCT x.* FROM {a} x JOIN {b} y ON y.d = x.d AND {_inside('x', 'y')} WHERE NOT EXISTS (SELECT 1 FROM {a} m WHERE m.d = x.d AND {_inside('x', 'm')} AND {_inside('m', 'y')})"
        if op == "nth_in":
            order = "x.s, x.e" if args[2] > 0 else "x.s DESC, x.e DESC"
            return f"SELECT DISTINCT d, s, e FROM (SELECT x.*, row_number() OVER (PARTITION BY y.d, y.s, y.e ORDER BY {order}) AS k FROM {a} x JOIN {b} y ON y.d = x.d AND {_inside('x', 'y')}) WHERE k = {abs(args[2])}"
        if op == "concat":
            p = f"SELECT DISTINCT d, unnest(range(s::BIGINT, e::BIGINT + 1)) AS p FROM {a}"
            return f"SELECT d, min(p) AS s, max(p) AS e FROM (SELECT d, p, p - row_number() OVER (PARTITION BY d ORDER BY p) AS g FROM ({p})) GROUP BY d, g"
        if op == "extracting":
            p = f"SELECT x.d, x.s, x.e, unnest(range(x.s::BIGINT, x.e::BIGINT + 1)) AS p FROM {a} x"
            hidden = self.add(f"SELECT DISTINCT d, unnest(range(s::BIGINT, e::BIGINT + 1)) AS p FROM {b}")
            left = f"SELECT q.* FROM ({p}) q WHERE NOT EXISTS (SELECT 1 FROM {hidden} h WHERE h.d = q.d AND h.p = q.p)"
            return f"SELECT DISTINCT d, min(p) AS s, max(p) AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY d, s, e ORDER BY p) AS g FROM ({left})) GROUP BY d, q_s, q_e, g".replace("SELECT *, p -", "SELECT d, s AS q_s, e AS q_e, p, p -")
        if op == "join":
            return f"SELECT d, s, e2 AS e FROM (SELECT d, s, lead(e, {args[0] - 1}) OVER (PARTITION BY d ORDER BY s, e) AS e2 FROM {a}) WHERE e2 IS NOT NULL"
        if op == "first_bytes":
            return f"SELECT DISTINCT d, s, least(e, s + {args[0] - 1}) AS e FROM {a}"
        if op == "last_bytes":
            return f"SELECT DISTINCT d, greatest(s, e - {args[0] - 1}) AS s, e FROM {a}"
        if op == "shorter":
            return f"SELECT * FROM {a} WHERE e - s + 1 < {args[0]}"
        if op in ("..", "._", "_.", "__"):
            ev = f"SELECT d, e AS p, 1 AS k, s AS tie, s, e FROM {a} UNION ALL SELECT d, s, -1, e, s, e FROM {b}"
            lv = f"SELECT *, sum(k) OVER (PARTITION BY d ORDER BY p, k, tie ROWS UNBOUNDED PRECEDING) + CASE k WHEN 1 THEN 0 ELSE 1 END AS depth FROM ({ev})"
            nx = f"SELECT *, lead(k) OVER w AS nk, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM ({lv}) WINDOW w AS (PARTITION BY d, depth ORDER BY p, k, tie)"
            s, e = "e + 1" if op[0] == "_" else "s", "ns - 1" if op[1] == "_" else "ne"
            return f"SELECT DISTINCT d, s, e FROM (SELECT d, {s} AS s, {e} AS e FROM ({nx}) WHERE k = 1 AND nk = -1) WHERE s <= e"
        if "quote" in op:
            step = self.add(f"SELECT x.d, x.s, x.e, r.s AS rs, r.e AS re FROM (SELECT d, s, e FROM {a}) x ASOF JOIN (SELECT d, s, min(e) AS e FROM {b} GROUP BY d, s) r ON x.d = r.d AND r.s > x.e")
            first = f"SELECT d, min(s) AS s FROM {a} GROUP BY d"
            nxt = self.add(f"SELECT t.d, t.s, t.e, t.rs, t.re, n.s AS ns, n.e AS ne FROM {step} t ASOF LEFT JOIN (SELECT d, s, min(e) AS e FROM {a} GROUP BY d, s) n ON t.d = n.d AND n.s > t.re")
            heads = self.add(f"SELECT t.* FROM {nxt} t JOIN (SELECT x.d, x.s, min(x.e) AS e FROM {a} x JOIN ({first}) f ON f.d = x.d AND f.s = x.s GROUP BY x.d, x.s) h ON h.d = t.d AND h.s = t.s AND h.e = t.e")
            name = f"walk{len(self.ctes)}"
            self.add(f"SELECT * FROM {heads} UNION ALL SELECT t.* FROM {name} w JOIN {nxt} t ON t.d = w.d AND t.s = w.ns AND t.e = w.ne", name)
            s, e = "e + 1" if op.startswith("_") else "s", "rs - 1" if op.endswith("_") else "re"
            return f"SELECT d, s, e FROM (SELECT d, {s} AS s, {e} AS e FROM {name}) WHERE s <= e"
        raise ValueError(f"no SQL for {op}")


def to_sql(n: Node, source: str) -> str:
    """SQL of an expression over source, a query that gives d (id), name and t (text)."""
    return Sql(source).query(n)
