"""Registered queries of the text-region engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import output
from .functions.macros import MACROS
from .model import docs_from, with_offsets
from .plans.parser import parse
from .plans.sql import to_sql
from .search import search, search_streams
from .sources.files import in_files
from .sources.index import Index, build_index
from .sources.shared import scratch

TABLES = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "benchmark": ("item_id", "text"), "events": ("event_id", "props")}
STREAMS = "SELECT conv_id AS d, conv_id::VARCHAR AS name, string_agg(text, '' ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"
FLAGSHIP = '("<title>" .. "</title>") containing word("the*")'

#: name -> (table, expression); each has an oracle made from the same expression.
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "phrase": ("documents", '"token"'),
    "phrase_escapes": ("documents", '"\\n" or "\\""'),
    "parentheses": ("documents", '"the" .. ("." or ",")'),
    "left_association": ("documents", '"the" .. "." or ","'),
    "start": ("documents", "start"),
    "end": ("documents", "end"),
    "chars": ("documents", "chars"),
    "constant_list": ("documents", "[(0,3) (2,9)]"),
    "char_class": ("documents", '"a" or "e" or "o"'),
    "file": ("documents", 'file("1*")'),
    "word": ("documents", 'word("the")'),
    "word_prefix": ("documents", 'word("tok*")'),
    "in": ("documents", '"the" in LINES'),
    "not_in": ("documents", '"the" not in ("the" .. ".")'),
    "containing": ("documents", 'LINES containing "token"'),
    "not_containing": ("documents", 'LINES not containing "the"'),
    "equal": ("documents", '("the" .. ".") equal ("the" .. ("." or ","))'),
    "not_equal": ("documents", '("the" .. ".") not equal ("the" .. ("." or ","))'),
    "inner": ("pages", 'inner("<p>" .. "</p>" or ("<div" .. "</div>") or ("<p>" .. "</div>"))'),
    "outer": ("pages", 'outer("<p>" .. "</p>" or ("<div" .. "</div>") or ("<p>" .. "</div>"))'),
    "parenting": ("pages", '("<div" .. "</div>" or ("<body" .. "</body>")) parenting "<p>"'),
    "childrening": ("pages", '("<div" .. "</div>" or ("<p>" .. "</p>")) childrening ("<body" .. "</body>")'),
    "near": ("documents", 'word("and") near(12) word("the")'),
    "before": ("documents", 'word("and") before(12) word("the")'),
    "pair_dots": ("pages", '"<p>" .. "</p>"'),
    "pair_without_right": ("pages", '"<p>" ._ "</p>"'),
    "pair_without_left": ("pages", '"<p>" _. "</p>"'),
    "pair_without_both": ("pages", '"<p>" __ "</p>"'),
    "pair_braces": ("events", '"{" .. "}"'),
    "quote": ("documents", '"the " quote "."'),
    "quote_without_left": ("documents", '"the " _quote "."'),
    "quote_without_right": ("documents", '"the " quote_ "."'),
    "quote_without_both": ("events", '"\\"" _quote_ "\\""'),
    "or": ("documents", '"the" or "and" or "la"'),
    "extracting": ("documents", 'ALL extracting ("th" or " " or "an")'),
    "concat": ("documents", 'concat("th" or "he" or "an" or " ")'),
    "join_n": ("documents", 'join(3, "the")'),
    "in_run": ("documents", '("the" .. ".") in join(40, chars)'),
    "first_bytes": ("documents", 'first_bytes(5, "the" .. ".")'),
    "last_bytes": ("documents", 'last_bytes(5, "the" .. ".")'),
    "first_in": ("documents", 'FIRST_IN("the", LINES)'),
    "second_in": ("documents", 'SECOND_IN("the", LINES)'),
    "third_in": ("documents", 'THIRD_IN("the", LINES)'),
    "last_in": ("documents", 'LAST_IN("the", LINES)'),
    "lines": ("documents", "LINES"),
    "words": ("documents", "WORDS"),
    "numerals": ("documents", "concat(NUMERAL)"),
    "regs_after": ("documents", 'REGS_AFTER(2, "the", "token")'),
    "regs_before": ("documents", 'REGS_BEFORE(2, "the", "token")'),
    "followed_by": ("documents", 'FBY("th", "er")'),
    "all_text": ("documents", "ALL"),
    "titles_containing": ("pages", FLAGSHIP),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return docs_from(spark.read.parquet(f"{sf_dir}/{table}.parquet"), *TABLES[table])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of web pages that contain a word, with their text."""
    docs = read(spark, sf_dir, "pages")
    return output.with_text(search(docs, FLAGSHIP), docs)


def _expression(table: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search(read(spark, sf_dir, table), query)


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over whole conversations: a turn is a file, a conversation is a stream."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return search_streams(turns, '"." .. "the"', "conv_id", "turn")


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the turn that each region begins in."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return in_files(stream(spark, sf_dir), turns, "conv_id", "turn")


def ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), '"TOKEN"', ignore_case=True)


def stags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "pages"), 'stag("p")')


def etags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "pages"), 'etag("p")')


def named_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "pages"), 'ELEMENTS("p")')


def all_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "pages"), "elements")


_LINES = '"token" .. "\\n"'


def output_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return output.short(search(docs, '"th" or "he" or "re"'), docs)


def output_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return output.long(search(docs, _LINES), with_offsets(docs))


def output_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return output.formatted(search(docs, _LINES), with_offsets(docs), "%n|%f|%i-%j|%l|%r")


def output_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("base", F.lit(0).cast("long"))
    return output.filtered(search(docs, '"the "'), docs, "<%r>")


def output_filter_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in which each region has its number among all regions."""
    docs = read(spark, sf_dir, "documents")
    return output.filtered(search(docs, '"token"'), with_offsets(docs), "[%n]")


def output_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.count(search(read(spark, sf_dir, "documents"), '"the"'))


def _index(spark: SparkSession, sf_dir: str, table: str = "documents", **options) -> Index:
    return build_index(read(spark, sf_dir, table), scratch(spark, "index"), **options)


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), 'word("the")', index=_index(spark, sf_dir, with_markup=False))


def index_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).lookup("word", "tok*")


def index_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).range("ba", "be").select("term", "doc_id", "start_pos", "end_pos")


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).terms("a", "c")


def index_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).docs


def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).dump()


def _stop_words(spark: SparkSession, sf_dir: str) -> Index:
    stop = spark.createDataFrame([("the",), ("and",), ("of",)], "term string")
    return _index(spark, sf_dir, stop_words=stop, with_markup=False)


def index_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an index built without its stop words, which stay listed with what was left out."""
    return _stop_words(spark, sf_dir).terms("", "")


def index_stop_word_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an index built without its stop words: they count all the same."""
    return _stop_words(spark, sf_dir).statistics()


def index_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).listing("a", "c")


def index_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements looked up in an index with markup."""
    return search(read(spark, sf_dir, "pages"), 'elements', index=_index(spark, sf_dir, "pages"))


def index_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags by the beginning of their names, looked up in an index with markup."""
    return search(read(spark, sf_dir, "pages"), 'stag("h*")', index=_index(spark, sf_dir, "pages"))


def stop_word_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).stop_word_candidates(200)


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).weights()


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, with_markup=False).statistics()


def _joined(rows: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """Documents made of the texts of the rows of one key, in order."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), "")
    return docs_from(rows.groupBy(key).agg(parts.alias("t")), key, "t")


def mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mailboxes: each turn is a message."""
    head = F.format_string("From %s@host Mon Jan  5 10:0%s:00 2026\nFrom: %s\nSubject: turn %s\nTo: all,\n  others\nDate: day %s\n\n", "role", F.col("turn") % 10, "role", "turn", "turn")
    return _joined(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n")))


def spools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as news spools: each turn is an article."""
    head = F.format_string("Path: host!%s\nFrom: %s\nSubject: turn %s\nNewsgroups: g\n\n", "turn", "role", "turn")
    start = F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit("\nFrom "), F.col("role"), F.lit("\n")))
    return _joined(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", F.concat(start, head, F.lit("Text: "), F.coalesce("text", F.lit("")), F.lit("\n")))


def c_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as C sources."""
    text = F.format_string("#include <%s.h>\n/* user %s */\nint %s_%s(long value) {\n  return %s;\n}\n", "event_type", "user_id", "event_type", "user_id", "event_id")
    return docs_from(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", text), "event_id", "t")


def macro_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as macro files of two definitions."""
    text = F.format_string('define(%s,( "x" ))\n# text\ndefine(N%s,( $1 ))\n', "event_type", "user_id")
    return docs_from(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", text), "event_id", "t")


#: name -> (documents, expression); their oracles are written by hand.
MADE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "mail_header": (mailboxes, "MAIL_HEADER"),
    "mail_message": (mailboxes, "MAIL_MESS"),
    "mail_body": (mailboxes, "MAIL_BODY"),
    "mail_from": (mailboxes, "MAIL_FROM"),
    "mail_subject": (mailboxes, "MAIL_SUBJ"),
    "mail_to": (mailboxes, "MAIL_TO"),
    "mail_date": (mailboxes, "MAIL_DATE"),
    "empty_lines": (mailboxes, "ELINE"),
    "news_article": (spools, "NEWS_ARTICLE"),
    "news_header": (spools, "NEWS_HEADER"),
    "news_body": (spools, "NEWS_BODY"),
    "news_subject": (spools, "NEWS_SUBJ"),
    "c_functions": (c_sources, "C_FUNCS"),
    "c_comments": (c_sources, "C_COMMENTS"),
    "c_directives": (c_sources, "C_PREPROCS"),
    "c_blocks": (c_sources, "C_BLOCKS"),
    "macro_names": (macro_files, "MACRO_NAMES"),
    "stags_of": (lambda spark, sf_dir: read(spark, sf_dir, "pages"), 'STAGS_OF(ELEMENTS("nav"))'),
    "etags_of": (lambda spark, sf_dir: read(spark, sf_dir, "pages"), 'ETAGS_OF(ELEMENTS("nav"))'),
    "having_parent": (lambda spark, sf_dir: read(spark, sf_dir, "pages"), 'HAVING_PARENT(ELEMENTS("a"), ELEMENTS("li"))'),
    "parents": (lambda spark, sf_dir: read(spark, sf_dir, "pages"), 'PARENTS(ELEMENTS("a"))'),
    "children": (lambda spark, sf_dir: read(spark, sf_dir, "pages"), 'CHILDREN(ELEMENTS("ul"))'),
    "root_elements": (lambda spark, sf_dir: read(spark, sf_dir, "pages"), "ROOT_ELEMENTS"),
    "in_run_beyond_the_text": (lambda spark, sf_dir: read(spark, sf_dir, "documents"), "[(0,4) (300,303)] in join(6, chars)"),
}


def _made(docs: Callable[[SparkSession, str], DataFrame], query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: search(docs(spark, sf_dir), query)


_OTHERS = [stream, stream_files, ignore_case, stags, etags, named_elements, all_elements, output_short, output_long, output_format, output_filter, output_filter_numbered, output_count, index_lookup, index_prefix_lookup, index_range_lookup, index_terms, index_file_list, index_dump, index_stop_words, stop_word_candidates, term_weights, index_statistics, index_stop_word_statistics, index_listing, index_elements, index_tags]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _expression(*x) for name, x in EXPRESSIONS.items()}
    out |= {name: _made(*x) for name, x in MADE.items()}
    return out | {f.__name__: f for f in _OTHERS}


def source(table: str) -> str:
    key, text = TABLES[table]
    return f"SELECT {key} AS d, {key}::VARCHAR AS name, {text} AS t FROM {table} WHERE {key} IS NOT NULL AND {text} IS NOT NULL"


def _sql(table: str, query: str) -> str:
    return to_sql(parse(query, MACROS), source(table))


_WORDS = "[0-9A-Za-zÀ-ÖØ-öø-ɏ]+"


def _tokens(table: str) -> str:
    both = f"regexp_extract_all(t, '{_WORDS}|[^{_WORDS[1:]}')"
    return f"SELECT c AS term, d AS doc_id, s::BIGINT AS start_pos, (s + length(c) - 1)::BIGINT AS end_pos FROM (SELECT *, sum(length(c)) OVER (PARTITION BY d ORDER BY i) - length(c) AS s FROM (SELECT d, unnest({both}) AS c, generate_subscripts({both}, 1) AS i FROM ({source(table)}))) WHERE regexp_full_match(c, '{_WORDS}')"


# Tags by pieces of the page: comments, declarations and scripts are pieces of their own.
_PIECES = """SELECT d, c, s::BIGINT AS s, (s + length(c) - 1)::BIGINT AS e FROM (SELECT *, sum(length(c)) OVER (PARTITION BY d ORDER BY i) - length(c) AS s FROM (
SELECT d, unnest(regexp_extract_all(t, '(?s)<!--.*?-->|<[!?][^>]*>|<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^<>]*>|[^<]+|<')) AS c, generate_subscripts(regexp_extract_all(t, '(?s)<!--.*?-->|<[!?][^>]*>|<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^<>]*>|[^<]+|<'), 1) AS i FROM (%s)))""" % source("pages")
_STAG = f"SELECT d AS doc_id, s AS start_pos, e AS end_pos FROM ({_PIECES}) WHERE regexp_full_match(c, '(?i)<p(\\s[^<>]*)?/?>')"
_ETAG = f"SELECT d AS doc_id, s AS start_pos, e AS end_pos FROM ({_PIECES}) WHERE regexp_full_match(c, '(?i)</p\\s*>')"
_ELEMENT = f"""WITH ev AS (SELECT doc_id, start_pos AS p, 1 AS k, start_pos AS s, end_pos AS e FROM ({_STAG}) UNION ALL SELECT doc_id, start_pos, -1, start_pos, end_pos FROM ({_ETAG})),
lv AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) + CASE k WHEN 1 THEN 0 ELSE 1 END AS depth FROM ev),
nx AS (SELECT *, lead(k) OVER w AS nk, lead(e) OVER w AS ne FROM lv WINDOW w AS (PARTITION BY doc_id, depth ORDER BY p))
SELECT doc_id, s AS start_pos, ne AS end_pos FROM nx WHERE k = 1 AND nk = -1"""
# All tags with their names; a script or style is a start tag, its text and an end tag.
_TAGS = f"""SELECT d, 'stag' AS kind, lower(regexp_extract(c, '^<([A-Za-z][A-Za-z0-9:_.-]*)', 1)) AS name, s, CASE WHEN regexp_matches(c, '(?is)^<(script|style)') THEN s + strpos(c, '>') - 1 ELSE e END AS e FROM ({_PIECES}) WHERE regexp_matches(c, '(?s)^<[A-Za-z].*>$')
UNION ALL SELECT d, 'etag', lower(regexp_extract(c, '^</([A-Za-z][A-Za-z0-9:_.-]*)', 1)), s, e FROM ({_PIECES}) WHERE regexp_matches(c, '(?s)^</[A-Za-z].*>$')
UNION ALL SELECT d, 'etag', lower(regexp_extract(c, '^<([A-Za-z]+)', 1)), e - length(regexp_extract(c, '(?is)</(?:script|style)>$')) + 1, e FROM ({_PIECES}) WHERE regexp_matches(c, '(?is)^<(script|style).*</(script|style)>$')
UNION ALL SELECT d, 'etag', lower(regexp_extract(c, '^<([A-Za-z][A-Za-z0-9:_.-]*)', 1)), s, e FROM ({_PIECES}) WHERE regexp_matches(c, '(?s)^<[A-Za-z][^<>]*/>$')"""
# An element ends where the running count of its name's tags first falls below what it was at the start tag.
_ELEMENTS = f"""WITH tg AS ({_TAGS}), ct AS (SELECT *, sum(CASE kind WHEN 'stag' THEN 1 ELSE -1 END) OVER w AS r, row_number() OVER w AS i FROM tg WINDOW w AS (PARTITION BY d, name ORDER BY s, kind DESC ROWS UNBOUNDED PRECEDING)),
en AS (SELECT x.d, x.name, x.s, min(y.i) AS i FROM ct x JOIN ct y ON y.d = x.d AND y.name = x.name AND y.i > x.i AND y.r = x.r - 1 WHERE x.kind = 'stag' GROUP BY x.d, x.name, x.s),
el AS (SELECT en.d, en.name, en.s, ct.e FROM en JOIN ct ON ct.d = en.d AND ct.name = en.name AND ct.i = en.i)"""


def _within(x: str, y: str) -> str:
    return f"{x}.d = {y}.d AND {x}.s >= {y}.s AND {x}.e <= {y}.e AND ({x}.s > {y}.s OR {x}.e < {y}.e)"


def _direct(what: str, inside: str, others: str, wanted: str = "x") -> str:
    """Regions of `what` in regions of `inside` without one of `others` between."""
    return f"""{_ELEMENTS}, st AS (SELECT d, s, e FROM tg WHERE kind = 'stag'), x AS ({what}), y AS ({inside}), o AS ({others})
SELECT DISTINCT {wanted}.d AS doc_id, {wanted}.s AS start_pos, {wanted}.e AS end_pos FROM x JOIN y ON {_within('x', 'y')} WHERE NOT EXISTS (SELECT 1 FROM o WHERE {_within('x', 'o')} AND {_within('o', 'y')})"""


_NAMED = "SELECT d, s, e FROM el WHERE name = '{}'"
_MAIL = """SELECT *, total - length(head) - length(body) AS pos FROM (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY d ORDER BY turn) AS total FROM (
SELECT conv_id AS d, turn, 'From ' || role || '@host Mon Jan  5 10:0' || (turn % 10) || ':00 2026' || chr(10) || 'From: ' || role || chr(10) || 'Subject: turn ' || turn || chr(10) || 'To: all,' || chr(10) || '  others' || chr(10) || 'Date: day ' || turn || chr(10) || chr(10) AS head, coalesce(text, '') || chr(10) AS body FROM conversations))"""
_NEWS = """SELECT *, total - length(pre) - length(head) - length(body) AS pos, max(total) OVER (PARTITION BY d) AS n FROM (SELECT *, sum(length(pre) + length(head) + length(body)) OVER (PARTITION BY d ORDER BY turn) AS total FROM (
SELECT conv_id AS d, turn, CASE turn WHEN 0 THEN '' ELSE chr(10) || 'From ' || role || chr(10) END AS pre, 'Path: host!' || turn || chr(10) || 'From: ' || role || chr(10) || 'Subject: turn ' || turn || chr(10) || 'Newsgroups: g' || chr(10) || chr(10) AS head, 'Text: ' || coalesce(text, '') || chr(10) AS body FROM conversations))"""
_C = "SELECT event_id AS d, '#include <' || event_type || '.h>' || chr(10) || '/* user ' || user_id || ' */' || chr(10) || 'int ' || event_type || '_' || user_id || '(long value) {' || chr(10) || '  return ' || event_id || ';' || chr(10) || '}' || chr(10) AS t FROM events"
_BLANK_LINES = """WITH t AS (SELECT d, string_agg(head || body, '' ORDER BY turn) AS t FROM ({}) GROUP BY d), l AS (SELECT d, unnest(string_split(t, chr(10))) AS c, generate_subscripts(string_split(t, chr(10)), 1) AS i, len(string_split(t, chr(10))) AS n FROM t),
p AS (SELECT *, sum(length(c) + 1) OVER (PARTITION BY d ORDER BY i) - length(c) - 1 AS s FROM l)
SELECT d AS doc_id, s::BIGINT AS start_pos, (s + length(c) - CASE WHEN i < n THEN 0 ELSE 1 END)::BIGINT AS end_pos FROM p WHERE trim(c, ' ' || chr(9) || chr(13)) = '' AND (i < n OR c <> '')"""


def _made_sql() -> dict[str, str]:
    def of(table: str, start: str, end: str, where: str = "true") -> str:
        return f"SELECT d AS doc_id, ({start})::BIGINT AS start_pos, ({end})::BIGINT AS end_pos FROM ({table}) WHERE {where}"

    def line(table: str, field: str, before: str = "0") -> str:
        first = f"pos + {before} + strpos(head, chr(10) || '{field}')"
        return of(table, first, f"{first} + strpos(substr(head, strpos(head, chr(10) || '{field}') + 1), chr(10)) - 1")

    start = "pos + CASE turn WHEN 0 THEN 0 ELSE 1 END"
    definition = "'define(' || event_type || ',( \"x\" ))' || chr(10) || '# text' || chr(10) || 'define('"
    return {
        "mail_header": of(_MAIL, "pos", "pos + length(head) - 1"),
        "mail_message": of(_MAIL, "pos", "total - 1"),
        "mail_body": of(_MAIL, "pos + length(head)", "total - 1"),
        "mail_from": line(_MAIL, "From: "),
        "mail_subject": line(_MAIL, "Subject: "),
        "mail_to": of(_MAIL, "pos + strpos(head, chr(10) || 'To: ')", "pos + strpos(head, chr(10) || 'Date: ') - 1"),
        "mail_date": line(_MAIL, "Date: "),
        "empty_lines": _BLANK_LINES.format(_MAIL),
        "news_article": of(_NEWS, start, "CASE WHEN total = n THEN n - 2 ELSE total END"),
        "news_header": of(_NEWS, start, "pos + length(pre) + length(head) - 2"),
        "news_body": of(_NEWS, "pos + length(pre) + length(head) - 1", "CASE WHEN total = n THEN n - 1 ELSE total + 5 END"),
        "news_subject": line(_NEWS, "Subject: ", "length(pre)"),
        "c_functions": of(_C, "strpos(t, '*/') + 1", "strpos(t, '{') - 2"),
        "c_comments": of(_C, "strpos(t, '/*') - 1", "strpos(t, '*/')"),
        "c_directives": of(_C, "0", "strpos(t, chr(10)) - 1"),
        "c_blocks": of(_C, "strpos(t, '{') - 1", "strpos(t, '}') - 1"),
        "macro_names": f"SELECT event_id AS doc_id, 7::BIGINT AS start_pos, (6 + length(event_type))::BIGINT AS end_pos FROM events UNION ALL SELECT event_id, length({definition})::BIGINT, (length({definition}) + length(user_id::VARCHAR))::BIGINT FROM events",
        "stags_of": _direct("SELECT * FROM st", _NAMED.format("nav"), "SELECT * FROM st UNION SELECT d, s, e FROM el"),
        "etags_of": f"{_ELEMENTS}, x AS ({_NAMED.format('nav')}) SELECT DISTINCT tg.d AS doc_id, tg.s AS start_pos, tg.e AS end_pos FROM tg JOIN x ON tg.d = x.d AND tg.s <= x.e AND tg.e >= x.e WHERE tg.kind = 'etag'",
        "having_parent": _direct(_NAMED.format("a"), _NAMED.format("li"), "SELECT d, s, e FROM el"),
        "parents": _direct(_NAMED.format("a"), "SELECT d, s, e FROM el", "SELECT d, s, e FROM el", "y"),
        "children": _direct("SELECT d, s, e FROM el", _NAMED.format("ul"), "SELECT d, s, e FROM el"),
        "root_elements": f"{_ELEMENTS} SELECT DISTINCT x.d AS doc_id, x.s AS start_pos, x.e AS end_pos FROM el x WHERE NOT EXISTS (SELECT 1 FROM el y WHERE {_within('x', 'y')})",
        "in_run_beyond_the_text": "SELECT doc_id, 0::BIGINT AS start_pos, 4::BIGINT AS end_pos FROM documents WHERE length(text) >= 6 UNION ALL SELECT doc_id, 300, 303 FROM documents WHERE length(text) > 303",
        "all_elements": f"{_ELEMENTS} SELECT DISTINCT d AS doc_id, s AS start_pos, e AS end_pos FROM el",
        "index_elements": f"{_ELEMENTS} SELECT DISTINCT d AS doc_id, s AS start_pos, e AS end_pos FROM el",
        "index_tags": f"SELECT DISTINCT d AS doc_id, s AS start_pos, e AS end_pos FROM ({_TAGS}) WHERE kind = 'stag' AND starts_with(name, 'h')",
    }


_LONG = f"""SELECT row_number() OVER (ORDER BY doc_id, start_pos, end_pos) AS ordinal, doc_id::VARCHAR AS file, end_pos - start_pos + 1 AS length,
(start_pos + base)::BIGINT AS start_pos, (end_pos + base)::BIGINT AS end_pos, start_pos AS file_start_pos, end_pos AS file_end_pos, substr(text, start_pos + 1, end_pos - start_pos + 1) AS region_text
FROM ({_sql("documents", _LINES)}) JOIN (SELECT doc_id, text, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS base FROM documents WHERE text IS NOT NULL) USING (doc_id)"""
_TERMS = "SELECT term, count(*) AS postings FROM ({}) GROUP BY term"


def oracle_sql() -> dict[str, str]:
    out = {name: _sql(*x) for name, x in EXPRESSIONS.items()}
    words = _tokens("documents")
    stream_sql = to_sql(parse('"." .. "the"'), STREAMS)
    islands = "SELECT doc_id, start_pos, end_pos, max(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({})".format(_sql("documents", '"th" or "he" or "re"'))
    runs = f"SELECT doc_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT *, sum(CASE WHEN m IS NULL OR start_pos > m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM ({islands})) GROUP BY doc_id, g"
    counts = f"""SELECT k.kind, k.terms, k.postings, k.stop_words, 100.0::DOUBLE * k.postings / sum(k.postings) OVER () AS percent, s.documents, s.characters FROM (SELECT 'word' AS kind, count(DISTINCT term) AS terms, count(*) AS postings, {{}} AS stop_words FROM ({words})
UNION ALL SELECT 'file', count(DISTINCT doc_id), count(*), 0 FROM documents WHERE text <> '') k, (SELECT count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents WHERE text IS NOT NULL) s"""
    return out | _made_sql() | {
        "stream": stream_sql,
        "stream_files": f"SELECT r.doc_id, r.start_pos, r.end_pos, f.file, (r.start_pos - f.base)::BIGINT AS file_start_pos, (r.end_pos - f.base)::BIGINT AS file_end_pos FROM ({stream_sql}) r JOIN (SELECT conv_id, turn AS file, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS base FROM conversations WHERE text <> '') f ON f.conv_id = r.doc_id AND r.start_pos >= f.base AND r.start_pos < f.base + f.n",
        "ignore_case": to_sql(parse('"token"'), source("documents").replace("text AS t", "lower(text) AS t")),
        "stags": _STAG,
        "etags": _ETAG,
        "named_elements": _ELEMENT,
        "output_short": f"SELECT doc_id, start_pos, end_pos, substr(text, start_pos + 1, end_pos - start_pos + 1) AS region_text FROM ({runs}) JOIN documents USING (doc_id)",
        "output_long": _LONG,
        "output_format": f"SELECT ordinal, ordinal || '|' || file || '|' || file_start_pos || '-' || file_end_pos || '|' || length || '|' || region_text AS line FROM ({_LONG})",
        "output_filter": "SELECT doc_id, replace(text, 'the ', '<the >') AS text FROM documents WHERE text IS NOT NULL",
        "output_filter_numbered": "WITH p AS (SELECT doc_id, unnest(string_split(text, 'token')) AS c, generate_subscripts(string_split(text, 'token'), 1) AS i FROM documents WHERE text <> ''), n AS (SELECT *, sum(CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id, i) AS k FROM p) SELECT doc_id, string_agg(CASE WHEN i > 1 THEN '[' || k || ']' ELSE '' END || c, '' ORDER BY i) AS text FROM n GROUP BY doc_id UNION ALL SELECT doc_id, text FROM documents WHERE text = ''",
        "output_count": f"SELECT count(*) AS regions FROM ({_sql('documents', chr(34) + 'the' + chr(34))})",
        "index_lookup": f"SELECT doc_id, start_pos, end_pos FROM ({words}) WHERE term = 'the'",
        "index_prefix_lookup": f"SELECT DISTINCT doc_id, start_pos, end_pos FROM ({words}) WHERE starts_with(term, 'tok')",
        "index_range_lookup": f"SELECT term, doc_id, start_pos, end_pos FROM ({words}) WHERE term >= 'ba' AND substr(term, 1, 2) <= 'be'",
        "index_terms": f"SELECT term, count(*) AS postings, false AS is_stop_word FROM ({words}) WHERE term >= 'a' AND substr(term, 1, 1) <= 'c' GROUP BY term",
        "index_file_list": "SELECT doc_id, doc_id::VARCHAR AS name, length(text) AS length FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
        "index_dump": f"SELECT term, doc_id, term || ':[' || string_agg('(' || start_pos || ',' || end_pos || ')', '' ORDER BY start_pos) || ']' AS line FROM ({words}) GROUP BY term, doc_id",
        "index_stop_words": f"SELECT term, count(*) AS postings, term IN ('the', 'and', 'of') AS is_stop_word FROM ({words}) GROUP BY term",
        "stop_word_candidates": f"SELECT term, postings FROM ({_TERMS.format(words)}) WHERE (SELECT count(*) FROM ({words})) // postings < 200",
        "term_weights": f"SELECT term, postings, 100.0::DOUBLE * postings / sum(postings) OVER () AS share FROM ({_TERMS.format(words)})",
        "index_listing": f"SELECT DISTINCT term AS line FROM ({words}) WHERE term >= 'a' AND substr(term, 1, 1) <= 'c'",
        "index_stop_word_statistics": counts.format("count(DISTINCT term) FILTER (term IN ('the', 'and', 'of'))"),
        "index_statistics": counts.format("0"),
    }
