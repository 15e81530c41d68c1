"""spanloom: structured text-region search as Spark DataFrame plans."""

VERSION = "0.2"

from .plans.ast import Node, char_class, chars, constant, elements, end, etag, file, phrase, stag, start, union, word
from .plans.parser import QueryError, parse
from .search import Result, release, run, search, search_streams, show
from .sources.index import Index, build_index

__all__ = ["Index", "Node", "QueryError", "Result", "build_index", "char_class", "chars", "constant", "elements", "end", "etag", "file", "parse", "phrase", "release", "run", "search", "search_streams", "show", "stag", "start", "union", "word"]
