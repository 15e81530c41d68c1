"""The command line: `python -m spanloom` searches, `python -m spanloom -I` makes and reads indexes.

Exit status of a search: 0 if regions were found, 1 if none were, 2 on an error. Default options
are read from SPANLOOM_OPTIONS, macros from ~/.spanloomrc unless -n is given.
"""

from __future__ import annotations

import argparse
import os
import shlex
import sys
import time

from . import VERSION
from .functions import markup, output
from .functions.textmacros import expand, load_macros
from .model import with_offsets
from .operators.sets import concat
from .plans.parser import QueryError, parse
from .search import Result, release, search, search_streams, show
from .sources import files
from .sources.index import Index, build_index, read_stop_words

COPYRIGHT = "spanloom: structured text-region search on Spark"
OPTIONS, MACRO_FILE = "SPANLOOM_OPTIONS", "~/.spanloomrc"


def _sources(p: argparse.ArgumentParser) -> None:
    p.add_argument("-F", dest="lists", action="append", default=[], metavar="FILE", help="read names of input files from FILE; they come before those on the command line")
    p.add_argument("-R", dest="recursive", action="store_true", help="go into folders")
    p.add_argument("-i", dest="ignore_case", action="store_true", help="ignore case; of an index: fold words to lower case")
    p.add_argument("-w", dest="word_chars", default=markup.WORD_CHARS, metavar="CHARS", help="characters of words, as in a class of a regular expression")
    p.add_argument("-g", dest="scan", action="append", default=[], choices=["markup", "no-markup", "utf-8", "utf-16"], help="options of the scanner")
    p.add_argument("-T", dest="statistics", action="store_true", help="show statistics")
    p.add_argument("-v", "-D", dest="verbose", action="store_true", help="show what is being done")
    p.add_argument("-V", dest="version", action="store_true", help="show the version")
    p.add_argument("-C", dest="copyright", action="store_true", help="show the copyright notice")
    p.add_argument("-m", dest="memory", type=int, metavar="MB", help="memory for indexing; here it belongs to Spark's configuration")
    p.add_argument("files", nargs="*", help="input files; - is standard input")


def query_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spanloom", description="Search files with region expressions.")
    p.add_argument("-e", dest="expressions", action="append", default=[], metavar="EXPR", help="an expression; several make one text")
    p.add_argument("-f", dest="expression_files", action="append", default=[], metavar="FILE", help="read the expression from FILE (-: standard input)")
    p.add_argument("-a", dest="filter", action="store_true", help="filter: show the whole text, with regions in their format")
    p.add_argument("-c", dest="count", action="store_true", help="show how many regions there are")
    p.add_argument("-d", dest="distinct", action="store_true", help="show each region, overlapping and nested ones too")
    p.add_argument("-s", dest="short", action="store_true", help="short output, the default: overlapping regions once")
    p.add_argument("-l", dest="long", action="store_true", help="long output: a line about each region before it")
    p.add_argument("-o", dest="style", metavar="FORMAT", help="format of output: %%f %%s %%e %%l %%i %%j %%r %%n")
    p.add_argument("-O", dest="style_file", metavar="FILE", help="read the format from FILE")
    p.add_argument("-N", dest="no_newline", action="store_true", help="no newline after the last region")
    p.add_argument("-n", dest="no_macros", action="store_true", help=f"don't read {MACRO_FILE}")
    p.add_argument("-p", dest="macro_files", action="append", default=[], metavar="FILE", help="read macros from FILE")
    p.add_argument("-P", dest="show", action="store_true", help="show the expression, macros expanded, and don't run it")
    p.add_argument("-S", dest="stream", action="store_true", help="take all input files as one text")
    p.add_argument("-t", dest="time", action="store_true", help="show the time taken")
    p.add_argument("-x", dest="index", metavar="INDEX", help="look words and markup up in an index; its documents are the input")
    p.add_argument("-q", dest="quiet", action="store_true", help="no messages")
    _sources(p)
    return p


def index_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spanloom -I", description="Make and read indexes.")
    p.add_argument("-c", dest="create", metavar="INDEX", help="make an index")
    p.add_argument("-x", dest="index", metavar="INDEX", help="read an index")
    p.add_argument("-q", dest="query", choices=["terms"], help="list terms: all, one, or those from a first to a last beginning")
    p.add_argument("-l", dest="limit", type=int, metavar="LIMIT", help="list terms whose postings the whole index holds fewer than LIMIT times over")
    p.add_argument("-L", dest="stop_out", metavar="FOLDER", help="write all terms with their postings, as a stop-word list")
    p.add_argument("-S", dest="stop_in", metavar="FILE", help="leave out the words of a stop-word list")
    _sources(p)
    return p


def _read(spark, a):
    encoding = "UTF-16" if "utf-16" in a.scan else "UTF-8"
    if a.files == ["-"] or not (a.files or a.lists):
        return files.read_stdin(spark)
    if "-" in a.files:
        raise ValueError("standard input can't be read along with files")
    return files.read_lists(spark, a.lists, a.files, recursive=a.recursive, encoding=encoding)


def _query(a, rest: list[str]) -> tuple[str, list[str]]:
    """(expression, files): without -e and -f the first argument is the expression."""
    parts = a.expressions + [files.read_expression(p) for p in a.expression_files]
    if not parts:
        if not rest:
            raise ValueError("no expression")
        parts, rest = rest[:1], rest[1:]
    return "\n".join(parts), rest


def run_query(spark, argv: list[str]) -> Result:
    a = query_parser().parse_args(argv)
    if a.version or a.copyright:
        return Result(0, f"spanloom {VERSION}\n" if a.version else COPYRIGHT + "\n")
    began = time.perf_counter()
    text, a.files = _query(a, a.files)
    own = os.path.expanduser(MACRO_FILE)
    macros = load_macros(*([own] if os.path.exists(own) and not a.no_macros else []), *a.macro_files)
    text = expand(text, macros)
    if a.show:
        return Result(0, show(text) + "\n")
    from .functions.macros import MACROS

    node = parse(text, MACROS)
    spark = spark()
    index = Index(spark, a.index) if a.index else None
    docs = index.texts() if index and not (a.files or a.lists) else _read(spark, a)
    options = {"ignore_case": a.ignore_case, "index": index, "word_chars": a.word_chars}
    if a.stream:
        docs = docs.selectExpr("0L s", "doc_id", "text")
        found = search_streams(docs, node, "s", "doc_id", **options)
        docs = files.concatenate(docs, "s", "doc_id")
    else:
        found = search(docs, node, **options)
    notes = []
    if a.count:
        n = found.count()
        out = Result(0 if n else 1, f"{n}\n")
    else:
        style = output.read_style(a.style_file) if a.style_file else a.style if a.style is not None else output.LONG if a.long else "%r"
        sized = with_offsets(docs)
        if a.filter:
            n = found.count()
            text = "".join(r.text for r in output.filtered(found, sized, style).orderBy("doc_id").toLocalIterator())
        else:
            found = found if a.distinct or a.long else concat(found, adjacent=False)
            text = output.render(output.formatted(found, sized, style), not a.no_newline)
            n = len(text)
        out = Result(0 if n else 1, text)
    if a.statistics:
        notes.append(f"{docs.count()} documents, {found.count()} regions")
    if a.time:
        notes.append(f"{time.perf_counter() - began:.2f} seconds")
    release(found)
    out.error = "".join(n + "\n" for n in notes)
    return out


def run_index(spark, argv: list[str]) -> Result:
    a = index_parser().parse_args(argv)
    if a.version or a.copyright:
        return Result(0, f"spanloom {VERSION}\n" if a.version else COPYRIGHT + "\n")
    if bool(a.create) == bool(a.index):
        raise ValueError("either -c or -x must name an index")
    spark, began, notes = spark(), time.perf_counter(), []
    if a.create:
        stop = read_stop_words(spark, a.stop_in) if a.stop_in else None
        index = build_index(_read(spark, a), a.create, stop_words=stop, word_chars=a.word_chars, ignore_case=a.ignore_case, with_markup="no-markup" not in a.scan, with_texts=True)
        notes.append(f"index made in {time.perf_counter() - began:.1f} seconds" if a.verbose else "")
    else:
        index = Index(spark, a.index)
    text = ""
    if a.query == "terms":
        if len(a.files) > 2:
            raise ValueError("terms are listed from a first to a last one")
        first, last = (*a.files, None, None)[:2]
        lines = index.listing(first or "", last if last is not None or first else "")
        text += "".join(r.line + "\n" for r in lines.toLocalIterator())
    if a.limit is not None:
        text += "".join(f"{r.postings} {r.term}\n" for r in index.stop_word_candidates(a.limit).orderBy("term").toLocalIterator())
    if a.stop_out:
        index.write_stop_words(a.stop_out)
    if a.statistics:
        for r in index.statistics().orderBy("kind").collect():  # one row a kind
            text += f"{r.kind}: {r.terms} terms ({r.stop_words} stop words), {r.postings} postings ({r.percent:.1f} %), {r.documents} documents, {r.characters} characters\n"
    found = a.query != "terms" or bool(text)
    return Result(0 if found else 1, text, "".join(n + "\n" for n in notes if n))


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("spanloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_command(argv: list[str], session=_session, options: str | None = None) -> Result:
    """What a command line gives. session: makes the Spark session, if one is needed."""
    try:
        given = shlex.split(os.environ.get(OPTIONS, "") if options is None else options)
        if argv[:1] == ["-I"]:
            return run_index(session, argv[1:])
        return run_query(session, given + argv)
    except SystemExit as e:  # argparse has said why
        return Result(0 if e.code in (0, None) else 2)
    except (QueryError, ValueError, OSError) as e:
        return Result(2, "", f"{e}\n")


def main() -> int:
    out = run_command(sys.argv[1:])
    sys.stdout.write(out.text)
    sys.stderr.write(out.error)
    return out.status
