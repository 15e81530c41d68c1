"""Queries, macros, markup, output, sources, index and streams."""

import random
import re

import pytest

import spanloom as sl
from spanloom.functions import macros as m
from spanloom.functions import markup, output
from spanloom.model import docs_from, with_offsets
from spanloom.plans.ast import Node, chars, constant, phrase, rewrite, word
from spanloom.sources import files
from spanloom.sources.index import Index, build_index, read_stop_words
from spanloom.streaming.search import search_stream


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "cast(doc_id as string) name", "text")


def found(spark, text, query, **options):
    rows = sl.search(docs_of(spark, text), query, **options).collect()
    return sorted((r.start_pos, r.end_pos) for r in rows)


CASES = [
    ("aaa", '"aa"', [(0, 1), (1, 2)]),
    ("x", "[(1,4) (3,6) (7,9)] extracting [(2,5) (4,7)]", [(1, 1), (8, 9)]),
    ("(a(b)c)d)(", '"(" .. ")"', [(0, 6), (2, 4)]),
    ('say "x" and "y" or "z', '"\\"" quote "\\""', [(4, 6), (12, 14)]),
    ('say "x" and "y" or "z', '"\\"" .. "\\""', [(4, 6), (6, 12), (12, 14), (14, 19)]),
    ("<a>1</a><b>2</b>", '"<a>".."</a>" or "</b>"', [(0, 7), (12, 15)]),
    ("<a>1</a><b>2</b>", '"<a>" .. ("</a>" or "</b>")', [(0, 7)]),
    ("x", "[(0,0) (2,3)] in [(0,0) (2,5)]", [(2, 3)]),
    ("x", "inner([(0,9) (2,5) (3,4) (7,8)])", [(3, 4), (7, 8)]),
    ("x", "outer([(0,9) (2,5) (3,4) (7,8)])", [(0, 9)]),
    ("x", "concat([(0,2) (3,4) (6,8) (7,7)])", [(0, 4), (6, 8)]),
    ("x", "join(2,[(0,0) (2,3) (5,6) (8,8)])", [(0, 3), (2, 6), (5, 8)]),
    ("ab\ncd\nef", "LINES", [(0, 2), (3, 5), (6, 7)]),
    ("ab", "chars or start or end", [(0, 0), (1, 1)]),
    ("", "start or end or chars", []),
    ("x", "[]", []),
    ("a#b # c", '"#" # a comment with "quotes"', [(1, 1), (4, 4)]),
    ("one\ttwo\\", '"\\t" or "\\\\"', [(3, 3), (7, 7)]),
    ("𝄞a𝄞a", '"a"', [(1, 1), (3, 3)]),
    ("abcabc", '"b" near(1) "c"', [(1, 1), (4, 4)]),
    ("abc abc", 'file("*")', [(0, 6)]),
    ("to be or be", 'word("be")', [(3, 4), (9, 10)]),
    ("to be or bet", 'word("be*")', [(3, 4), (9, 11)]),
    ("ab12", "WORDS or NUMERAL", [(0, 1), (2, 2), (3, 3)]),
    ("ab cd", 'FBY("a","b")', [(0, 1)]),
    ("x1 y2 x3", 'FIRST_IN(NUMERAL, ALL)', [(1, 1)]),
    ("x1 y2 x3", 'LAST_IN(NUMERAL, ALL)', [(7, 7)]),
    ("abcdef", '("a".."f") in join(7, chars)', []),
    ("abcdefgh", '("a".."f") in join(7, chars)', [(0, 5)]),
]


@pytest.mark.parametrize("text,query,want", CASES)
def test_cases(spark, text, query, want):
    assert found(spark, text, query) == want
    assert found(spark, text, sl.show(query)) == want, "an expression that is shown parses to the same"


def test_ignore_case(spark):
    assert found(spark, "Ab aB ß", '"AB"', ignore_case=True) == [(0, 1), (3, 4)]
    assert found(spark, "Ab aB", 'word("AB")', ignore_case=True) == [(0, 1), (3, 4)]


@pytest.mark.parametrize("bad", ['"a" in', '"a" not "b"', "[(3,1)]", "[(2,3) (1,2)]", '"a" "b"', "join(0, chars)", '"a', '""', "nothing", "(start", "stag(x)"])
def test_errors(bad):
    with pytest.raises(sl.QueryError):
        sl.parse(bad)


def test_rewrites():
    a, b = phrase("a"), phrase("b")
    assert rewrite(a.or_(b).or_(phrase("c"))) == Node("class", ("abc",))
    assert rewrite(a.not_containing(a)).op == "inner" and rewrite(a.not_in(a)).op == "outer"
    assert rewrite(a.within(chars.join(5))).op == "in_run"


def test_rewritten_queries_agree(spark):
    rng = random.Random(3)
    docs = docs_of(spark, *["".join(rng.choice("ab<>\n") for _ in range(rng.randrange(12))) for _ in range(80)])
    from spanloom.plans.compile import Compiler

    for q in ('"a" or "b" or "<"', '("a" .. "b") in join(4, chars)', '("<" .. ">") not containing ("<" .. ">")', '("<" .. ">") not in ("<" .. ">")'):
        node = sl.parse(q)
        c = Compiler(docs)
        c.patterns = sorted({(n.op, n.args[0]) for n in sl.plans.ast.walk(node) if n.op == "phrase"})
        c.scanned = __import__("spanloom.operators.leaves", fromlist=["scan"]).scan(docs, c.patterns)
        assert {tuple(r) for r in c.compile(node).collect()} == {tuple(r) for r in sl.search(docs, node).collect()}


PAGE = '<html><head><title>The A</title></head><body><p class="a>b">x<br/>y</p><!-- <p> --><script>"</p>"</script><P>z</p></body></html>'


def test_markup(spark):
    def texts(q):
        return [PAGE[s : e + 1] for s, e in found(spark, PAGE, q)]

    assert texts('stag("p")') == ['<p class="a>b">', "<P>"]
    assert texts('etag("p")') == ["</p>", "</p>"]
    assert texts('stag("br") or etag("br")') == ["<br/>"]
    assert texts('ELEMENTS("title")') == ["<title>The A</title>"]
    assert texts('stag("title") .. etag("title") containing word("The")') == ["<title>The A</title>"]
    assert texts("ROOT_ELEMENTS") == [PAGE]
    assert len(texts("elements")) == 8
    assert [t[:7] for t in texts('PARENTS(ELEMENTS("title"))')] == ["<head><"]
    assert sorted(t[:6] for t in texts('CHILDREN(ELEMENTS("html"))')) == ["<body>", "<head>"]


MAIL = "From a@x Mon 5 10:00:00\nFrom: a\nSubject: one\nTo: b,\n c\nDate: d1\n\nbody 1\nFrom here on we go\nFrom b@y Tue 6 11:30:00\nFrom: b\nSubject: two\n\nbody From: me\n"


def test_mail(spark):
    def texts(q):
        return [MAIL[s : e + 1] for s, e in found(spark, MAIL, q)]

    assert texts("MAIL_SUBJ") == ["Subject: one\n", "Subject: two\n"]
    assert texts("MAIL_FROM") == ["From: a\n", "From: b\n"]
    assert texts("MAIL_TO") == ["To: b,\n c\n"]
    assert texts("MAIL_DATE") == ["Date: d1\n"]
    assert [t[-7:] for t in texts("MAIL_MESS")] == [" we go\n", "om: me\n"]
    assert texts("MAIL_BODY") == ["body 1\nFrom here on we go\n", "body From: me\n"]
    assert texts("MAIL_HSTART") == ["From ", "From "]


NEWS = "Path: p1\nFrom: a\nNewsgroups: g\n\ntext\n\nFrom x\nPath: p2\n\nmore"


def test_news(spark):
    def texts(q):
        return [NEWS[s : e + 1] for s, e in found(spark, NEWS, q)]

    assert texts("NEWS_GROUPS") == ["Newsgroups: g\n"]
    assert texts("NEWS_FROM") == ["From: a\n"]
    assert len(texts("NEWS_ARTICLE")) == 2 and len(texts("NEWS_BODY")) == 2


C = '#include "x.h" \\\n more\n/* { } */\nint main(int a) {\n  if (a > access(1)) { b(); }\n}\n'


def test_c(spark):
    def texts(q):
        return [C[s : e + 1] for s, e in found(spark, C, q)]

    assert texts("C_COMMENTS") == ["/* { } */"]
    assert texts("C_PREPROCS") == ['#include "x.h" \\\n more\n']
    assert [t.count("\n") for t in texts("C_BLOCKS")] == [2, 0]
    assert texts('IF_COND containing "access"') == ["if (a > access(1))"]
    assert any("main(int a)" in t for t in texts("C_FUNCS"))


def test_all_macros_compile(spark):
    docs = docs_of(spark, C, MAIL, NEWS, PAGE)
    x = phrase("a")
    for name, f in m.MACROS.items():
        args = {"REGS_AFTER": (2, x, x), "REGS_BEFORE": (2, x, x), "ELEMENTS": ("p",), "NEWS_HLINE": ("Path:",)}.get(name)
        if args is None:
            n = f.__code__.co_argcount
            args = (x,) * n
        assert sl.search(docs, f(*args)).columns == ["doc_id", "start_pos", "end_pos"], name


def test_streams_cross_files(spark):
    f = spark.createDataFrame([(1, 0, "ab<"), (1, 1, "x>c"), (2, 0, "<"), (3, 0, None), (3, 1, "<>")], "conv long, turn long, text string")
    got = sl.search_streams(f, '"<" .. ">"', "conv", "turn")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 4), (3, 0, 1)]
    back = files.in_files(got, f, "conv", "turn").orderBy("doc_id").collect()
    assert [(r.file, r.file_start_pos) for r in back] == [(0, 2), (1, 0)]


def test_output(spark):
    docs = docs_of(spark, "abcdef", "", "xaby")
    got = sl.search(docs, '"ab" or "bc"')
    offs = with_offsets(docs)
    assert sorted(r.region_text for r in output.short(got, docs).collect()) == ["ab", "abc"]
    rows = sorted(output.long(got, offs).collect())
    assert [(r.ordinal, r.file, r.length, r.start_pos, r.end_pos, r.file_start_pos, r.region_text) for r in rows] == [(1, "0", 2, 0, 1, 0, "ab"), (2, "0", 2, 1, 2, 1, "bc"), (3, "2", 2, 7, 8, 1, "ab")]
    assert sl.run(docs, '"ab"', style="%n:%f:%s-%e(%l)%i,%j=%r%%\\n").text == "1:0:0-1(2)0,1=ab%\n2:2:7-8(2)1,2=ab%\n"
    assert sl.run(docs, '"ab"').text == "abab\n" and sl.run(docs, '"ab"', newline=False).text == "abab"
    assert [sl.run(docs, q).status for q in ('"ab"', '"zz"', '"')] == [0, 1, 2]
    assert sl.run(docs, '"ab"', count=True).text == "2\n"
    assert {r.doc_id: r.text for r in output.filtered(got, offs, "[%r]").collect()} == {0: "[abc]def", 1: "", 2: "x[ab]y"}


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["be", "bet", "better", "to", "The", "x1", "été"]
    docs = docs_of(spark, *[" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(60)], PAGE)
    stop = tmp_path / "stop.txt"
    stop.write_text("12 to\nThe\n\n")
    idx = build_index(docs, str(tmp_path / "idx"), read_stop_words(spark, str(stop)))
    for q in ('word("be")', 'word("be*")', 'stag("p")', "elements", 'etag("*")', 'stag("title") .. etag("title") containing word("A")'):
        assert {tuple(r) for r in sl.search(docs, q, index=idx).collect()} == {tuple(r) for r in sl.search(docs, q).collect()}, q
    assert sl.search(docs, 'word("to")', index=idx).count() == 0
    terms = [(r.term, r.is_stop_word) for r in Index(spark, str(tmp_path / "idx")).terms("b", "to").collect()]
    assert [t for t, _ in terms] == sorted(t for t, _ in terms) and ("to", True) in terms and ("better", False) in terms and not any(t == "A" for t, _ in terms)
    assert [r.term for r in idx.terms("be").collect()] == ["be"]
    assert {r.term for r in idx.range("be", "bet").select("term").collect()} == {"be", "bet", "better"}
    assert all(re.fullmatch(r"\S+:\[(\(\d+,\d+\))+\]", r.line) for r in idx.dump().collect())
    assert idx.stop_word_candidates(8).count() > 0
    idx.write_stop_words(str(tmp_path / "weights"))
    assert read_stop_words(spark, str(tmp_path / "weights")).count() == idx.terms().where("not is_stop_word").count()
    assert idx.statistics().where("kind = 'file'").first().postings == docs.where("text != ''").count()
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path))


def test_sources(spark, tmp_path):
    for n, t in (("a.c", "ab"), ("b.txt", "é")):
        (tmp_path / n).write_text(t, encoding="utf-8")
    (tmp_path / "u16").write_bytes("xé".encode("utf-16"))
    assert sorted(r.text for r in files.read_files(spark, [str(tmp_path)], glob="*.*").collect()) == ["ab", "é"]
    assert files.read_files(spark, [str(tmp_path / "u16")], encoding="UTF-16").first().text == "xé"
    names = tmp_path / "names"
    names.write_text(f"{tmp_path}/a.c\n\n")
    assert [r.text for r in files.read_lists(spark, [str(names)]).collect()] == ["ab"]
    with pytest.raises(ValueError):
        files.read_files(spark, [])
    q = tmp_path / "q"
    q.write_text('"a"')
    assert files.read_expression(str(q)) == '"a"'
    import io

    assert files.read_stdin(spark, io.StringIO("abc")).first().text == "abc"


def test_structured_streaming(spark, tmp_path):
    docs = docs_of(spark, "<a>", "b", "<<c>")
    docs.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = search_stream(source, '"<" .. ">"', str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "start_pos", "end_pos").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 2), (2, 1, 3)]


def test_phrases_against_brute_force(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab\\E.\n𝄞") for _ in range(rng.randrange(20))) for _ in range(200)]
    docs = docs_of(spark, *texts)
    for p in ("a", "aa", "\\E", "a.", "\n", "𝄞a", "aba"):
        want = {(d, i, i + len(p) - 1) for d, t in enumerate(texts) for i in range(len(t)) if t.startswith(p, i)}
        assert {tuple(r) for r in sl.search(docs, phrase(p)).collect()} == want


def test_texts_are_scanned_and_shuffled_once(spark):
    docs = docs_of(spark, "<p>a</p>")
    plan = sl.search(docs, '("<p>" .. "</p>") containing "a"')._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_docs_from_drops_what_is_no_document(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k long, t string")
    assert docs_from(df, "k", "t").count() == 1
    assert with_offsets(docs_from(df, "k", "t").where("false")).count() == 0
    assert markup.tokens(docs_of(spark, None, "a b")).count() == 2
    assert sl.search(docs_of(spark, None, "a b"), word("a").or_(constant([(0, 0)]))).count() >= 1


def test_tags_of(spark):
    """Start tags directly in a region; end tags that it ends with."""
    page = "<div><p>a</p></div>"
    assert found(spark, page, 'STAGS_OF(ELEMENTS("div"))') == [(0, 4)]
    assert found(spark, page, 'ETAGS_OF(ELEMENTS("div"))') == [(13, 18)]
    assert found(spark, page, 'HAVING_PARENT(ELEMENTS("p"), ELEMENTS("div"))') == [(5, 12)]


def test_runs_end_with_the_text(spark):
    assert found(spark, "abcdefghij", "[(2,4) (8,10) (20,22)] in join(5, chars)") == [(2, 4)]


def test_numbered_characters(spark):
    assert found(spark, "aAé", '"\\#65;\\#xe9;"') == [(1, 2)]
    with pytest.raises(sl.QueryError):
        sl.parse('"\\#xd800;"')


def test_large_shared_parts_are_tables(spark):
    docs = docs_of(spark, MAIL)
    got = sl.search(docs, "MAIL_BODY")
    assert got.tables and got.count() == 2
    sl.release(got)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        got.count()


def test_bare_phrases_are_not_shuffled(spark):
    plan = sl.search(docs_of(spark, "a"), '"a"')._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stop_words_count(spark, tmp_path):
    docs = docs_of(spark, "to be or not to be", "be")
    stop = spark.createDataFrame([("to",)], "term string")
    index = build_index(docs, f"{tmp_path}/i", stop_words=stop, with_markup=False)
    r = {x.kind: x for x in index.statistics().collect()}
    assert (r["word"].terms, r["word"].postings, r["word"].stop_words) == (4, 7, 1) and r["file"].postings == 2
    assert abs(sum(x.percent for x in r.values()) - 100) < 1e-9
    assert {(x.term, x.postings, x.is_stop_word) for x in index.terms("", "").collect()} == {("be", 3, False), ("not", 1, False), ("or", 1, False), ("to", 2, True)}
    cursor = index.entries("n", "z")
    assert (cursor.term, cursor.size) == ("not", 1) and cursor.next() and cursor.term == "or"
    assert list(cursor) == [("or", 1), ("to", 2)] and not cursor.next()
    cursor.close()
    assert cursor.term is None


def test_listing_is_escaped(spark, tmp_path):
    index = build_index(docs_of(spark, 'a"b\\c\x01d\te'), f"{tmp_path}/i", word_chars='a-e"\\x01\\\\', with_markup=False)
    assert [r.line for r in index.listing("", "").collect()] == ['a\\"b\\\\c\\#x1;d', "e"]


def test_failed_index_leaves_nothing(spark, tmp_path):
    docs = docs_of(spark, "a b")
    bad = spark.createDataFrame([("x",)], "other string")
    with pytest.raises(Exception):
        build_index(docs, f"{tmp_path}/i", stop_words=bad)
    assert not (tmp_path / "i").exists()


def test_files_keep_their_order(spark, tmp_path):
    names = ["f3", "f1", "f10", "f2"]
    for n in [*names, "g1"]:
        (tmp_path / n).write_text(f"text of {n}")
    (tmp_path / "d").mkdir()
    for n in ("y", "x"):
        (tmp_path / "d" / n).write_text(n)
    docs = files.read_files(spark, [f"{tmp_path}/{n}" for n in names] + [f"{tmp_path}/d", f"{tmp_path}/g*", f"{tmp_path}/f1"])
    got = [(r.doc_id, r.name.rpartition("/")[2]) for r in docs.orderBy("doc_id").collect()]
    assert got == list(enumerate([*names, "x", "y", "g1"]))
    (tmp_path / "list").write_text("".join(f"{tmp_path}/{n}\n" for n in reversed(names)))
    docs = files.read_lists(spark, [f"{tmp_path}/list"], [f"{tmp_path}/g1"])
    assert [r.text[8:] for r in docs.orderBy("doc_id").collect()] == [*reversed(names), "g1"]


def test_offsets_of_ids_of_any_size(spark):
    docs = spark.createDataFrame([(-9 * 10**18, "a", "ab"), (9 * 10**18, "b", "c"), (0, "c", "def")], "doc_id long, name string, text string")
    assert [(r.seq, r.base) for r in with_offsets(docs).orderBy("doc_id").collect()] == [(0, 0), (1, 2), (2, 5)]


def test_filter_numbers_regions(spark):
    docs = docs_of(spark, "a b a", "b", "a")
    got = output.filtered(sl.search(docs, '"a"'), with_offsets(docs), "<%n%r%%n>")
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["<1a%n> b <2a%n>", "b", "<3a%n>"]


def test_text_macros():
    from spanloom.functions.textmacros import MacroError, expand, read_macros

    table = read_macros('# a comment, define(NO, 1)\ndefine(B,( "(" .. ")" ))\ndefine(HEAD,("\\n$1 " in $2))\nchangecom\ndefine(LOOP, LOOP)\ndefine(NESTED, HEAD(From:, B))')
    assert set(table) == {"B", "HEAD", "LOOP", "NESTED"}
    assert expand("NESTED or x", table) == '("\\nFrom: " in ( "(" .. ")" )) or x'
    assert expand('"B" or B', table) == '"B" or ( "(" .. ")" )'
    sl.parse(expand("NESTED", table))
    with pytest.raises(MacroError):
        expand("LOOP", table)
    with pytest.raises(MacroError):
        read_macros("define(A")


def test_command_line(spark, tmp_path):
    from spanloom.cli import run_command

    (tmp_path / "b.txt").write_text("say the word\nthe end\n")
    (tmp_path / "a.txt").write_text("nothing\n")
    (tmp_path / "q").write_text('"the" .. "\\n"')
    (tmp_path / "m").write_text('define(T,("the"))\n')
    b, a = f"{tmp_path}/b.txt", f"{tmp_path}/a.txt"
    go = lambda *x, **k: run_command(list(x), lambda: spark, **{"options": "", **k})
    assert (go('"the"', b, a).text, go('"the"', b).status, go('"xyz"', b).status) == ("thethe\n", 0, 1)
    assert go("-c", "-e", '"the"', a, b).text == "2\n"
    assert go("-f", f"{tmp_path}/q", b).text == "the word\nthe end\n"
    assert go("-o", "%n:%f|%i-%j\\n", "-e", '"the"', a, b).text.replace(str(tmp_path), "").replace("file:", "") == "1:/b.txt|4-6\n2:/b.txt|13-15\n"
    assert go("-p", f"{tmp_path}/m", "-P", "T or T").text == '"the" or "the"\n'
    assert go("-N", '"the end"', b).text == "the end"
    assert go("-d", "-c", "-e", '"the" or "th"', b).text == "4\n"
    assert go("-S", "-c", "-e", '"\\n" .. "say"', a, b).text == "1\n" and go("-c", "-e", '"\\n" .. "say"', a, b).status == 1
    assert go("-a", "-o", "<%r>", '"the"', b).text == "say <the> word\n<the> end\n"
    assert go("-l", '"end"', b).text.startswith("------------- #1 ")
    assert go('"the', b).status == 2 and go(b).status == 2 and go("-Z").status == 2
    assert go("-V").text.startswith("spanloom ") and "Spark" in go("-C").text and go("-h").status == 0
    assert go("-c", '"THE"', b, options="-i").text == "2\n"
    index = f"{tmp_path}/index"
    made = go("-I", "-c", index, "-T", b, a)
    assert made.status == 0 and "word: 5 terms" in made.text
    assert go("-I", "-x", index, "-q", "terms").text == "end\nnothing\nsay\nthe\nword\n"
    assert go("-I", "-x", index, "-q", "terms", "s", "t").text == "say\nthe\n" and go("-I", "-x", index, "-q", "terms", "zz").status == 1
    assert go("-I", "-x", index, "-l", "4").text == "2 the\n"
    assert go("-I", "-x", index, "-L", f"{tmp_path}/stop").status == 0
    assert go("-I", "-c", f"{tmp_path}/i2", "-S", f"{tmp_path}/stop", a).status == 0
    assert go("-x", index, 'word("the")').text == "thethe\n" and go("-x", f"{tmp_path}/none", 'word("the")').status == 2
    assert go("-I").status == 2


def test_scanner_options(spark, tmp_path):
    """Encodings, folders, characters of words, folding when an index is made, and a style from a file."""
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a").write_bytes("Ünder_score x-y".encode("utf-16"))
    (tmp_path / "d" / "e" / "b").write_bytes("second x-y".encode("utf-16"))
    docs = files.read_files(spark, [f"{tmp_path}/d"], recursive=True, encoding="UTF-16")
    assert [r.text for r in docs.orderBy("doc_id").collect()] == ["Ünder_score x-y", "second x-y"]
    assert [r.text for r in files.read_files(spark, [f"{tmp_path}/d"], encoding="UTF-16").collect()] == ["Ünder_score x-y"]
    chars = markup.WORD_CHARS + "_-"
    assert sl.search(docs, 'word("x-y")', word_chars=chars).count() == 2 and sl.search(docs, 'word("x-y")').count() == 0
    index = build_index(docs, f"{tmp_path}/i", word_chars=chars, ignore_case=True, with_markup=False)
    assert [r.term for r in index.terms("", "").collect()] == ["second", "x-y", "ünder_score"]
    assert sl.search(docs, 'word("X-Y")', index=index).count() == 2
    (tmp_path / "style").write_text("%n. %r\\n")
    got = output.formatted(sl.search(docs, '"x-y"'), with_offsets(docs), output.read_style(f"{tmp_path}/style"))
    assert output.render(got) == "1. x-y\n2. x-y\n"


@pytest.mark.parametrize("query", ['"a" not in ("a" .. "b")', '"a" .. "b" or "c"', '("a" .. "b") equal ("a" .. ("b" or "c"))', 'ALL extracting ("a" or "b")', 'concat("ab" or "b")', "WORDS", "MACRO_NAMES", "LINES", 'FIRST_IN("a", LINES)'])
def test_whole_expressions_are_evaluated_in_the_scan(spark, query):
    """No shuffle, sort or window, so no task holds more than a slice of documents."""
    plan = sl.search(docs_of(spark, "abc"), query)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Sort|Window|Join", plan)


def test_evaluation_in_the_scan_equals_the_operators(spark, monkeypatch):
    """Random expressions, over texts of both widths of characters, in slices of several documents."""
    from spanloom.operators import local
    from spanloom.plans.compile import Compiler

    rng = random.Random(8)
    texts = ["".join(rng.choice("aab<>.\n é𝄞A1"[: 6 + i % 8]) for _ in range(rng.choice([0, 1, 9, 30]))) for i in range(60)]
    docs = docs_of(spark, *texts).cache()
    a, b, c = '"a"', '("b" or "<")', '[(0,2) (1,1) (1,5) (40,80)]'
    queries = [f"{a} {op} {b} {more} {c}" for op, more in (("..", "or"), ("._", "not in"), ("_.", "containing"), ("__", "extracting"), ("quote", "equal"), ("_quote_", "not equal"), ("near(2)", "or"), ("before(1)", "not containing"), ("or", "in"), ("or", "extracting"))]
    queries += [f"{f}({x})" for f, x in (("inner", f"{a} .. {b}"), ("outer", c), ("concat", f"{a} or {c}"), ("join", f"2, {c}"), ("first_bytes", f"2, {c}"), ("last_bytes", f"2, {a} .. {b}"), ("nth_in", f"-1, {a}, {c}"))]
    queries += ['word("a*") in (start .. end)', 'file("1*") extracting "\\n"', f"({a} .. {b}) parenting {a}", f"{a} childrening {c}"]
    monkeypatch.setattr(local, "SLICE_DOCS", 7)
    for q in queries:
        got = sorted(map(tuple, sl.search(docs, q).collect()))
        with monkeypatch.context() as m:
            m.setattr(local, "known", lambda n: False)
            want = sorted(map(tuple, Compiler(docs).run(sl.parse(q, m_macros())).collect()))
        assert got == want and len(got) == len(set(got)), q


def m_macros():
    return m.MACROS


def test_documents_that_share_an_id(spark):
    """Their regions are those of one document, as before."""
    docs = spark.createDataFrame([(1, "1", "ab"), (1, "1", "zzz b"), (2, "2", "a")], "doc_id long, name string, text string")
    assert sorted(map(tuple, sl.search(docs, '"a" .. "b"').collect())) == [(1, 0, 1)]
    assert sorted(map(tuple, sl.search(docs, '"zz" containing "b"').collect())) == [(1, 0, 1), (1, 1, 2)]


def test_index_rows_are_lists(spark, tmp_path, monkeypatch):
    """A term's postings in a slice of documents are one row; dumping words shuffles nothing, if ids tell documents apart."""
    from spanloom.sources import index as ix

    texts = ["to be or not to be", "", "été be 𝄞to be", "İx be", "to", "be" * 3 + " be"]
    docs = docs_of(spark, *texts).coalesce(1)
    i = build_index(docs, f"{tmp_path}/a", with_markup=False)
    assert [(r.n, r.doc_id) for r in i.lists.where("kind = 'word' and term = 'be'").collect()] == [(6, 0)]
    want = {(t, d, s, s + len(t) - 1) for d, x in enumerate(texts) for t, s in ((w.group(), w.start()) for w in re.finditer(f"[{markup.WORD_CHARS}]+", x))}
    assert {(r.term, r.doc_id, r.start_pos, r.end_pos) for r in i.postings.where("kind = 'word'").collect()} == want
    assert "Exchange" not in i.dump()._jdf.queryExecution().executedPlan().toString()
    lines = {(r.term, r.doc_id): r.line for r in i.dump().collect()}
    assert lines["be", 0] == "be:[(3,4)(16,17)]" and len(lines) == len({x[:2] for x in want})
    monkeypatch.setattr(ix, "SLICE_BYTES", 4)  # a row for each document
    j = build_index(docs, f"{tmp_path}/b", with_markup=False)
    assert {(r.term, r.doc_id, r.start_pos, r.end_pos) for r in j.postings.where("kind = 'word'").collect()} == want
    assert j.lists.where("term = 'be'").count() == 4 and {(r.term, r.postings) for r in j.terms("", "").collect()} == {(r.term, r.postings) for r in i.terms("", "").collect()}
    folded = build_index(docs, f"{tmp_path}/c", ignore_case=True, with_markup=False)
    assert {(r.term, r.start_pos, r.end_pos) for r in folded.lookup("word", "*").join(folded.postings.where("kind = 'word' and doc_id = 3"), ["doc_id", "start_pos", "end_pos"]).collect()} == {("İx".lower(), 0, 1), ("be", 3, 4)}
    twice = build_index(docs.unionAll(docs), f"{tmp_path}/d", with_markup=False)
    assert {(r.term, r.doc_id): r.line for r in twice.dump().collect()}["be", 0] == "be:[(3,4)(3,4)(16,17)(16,17)]"


def test_filter_meets_each_text_once(spark):
    """No text is shuffled or sorted with each of its regions."""
    docs = docs_of(spark, "ab abc", "", "x", "𝄞ab")
    got = output.filtered(sl.search(docs, '"ab"'), with_offsets(docs), "<%f|%s-%e|%l|%i-%j|%r|%%>")
    assert {r.doc_id: r.text for r in got.collect()} == {0: "<0|0-1|2|0-1|ab|%> <0|3-4|2|3-4|ab|%>c", 1: "", 2: "x", 3: "𝄞<3|8-9|2|1-2|ab|%>"}
    plan = output.filtered(sl.search(docs, '"ab"'), docs.selectExpr("*", "0L base"), "%r")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window[^\n]*text", plan)
