"""Named expressions: lines, words, order, markup, mailboxes, news spools and C sources.

Each is a function of nodes; MACROS gives them names for use in queries.
"""

from __future__ import annotations

import string

from ..plans.ast import Node, as_node, char_class, elements, end, etag, phrase, stag, start

NL = phrase("\n")


# Characters, lines and words
def numeral() -> Node:
    return char_class(string.digits)


def blank() -> Node:
    return char_class(" \t\r\n")


def lower() -> Node:
    return char_class(string.ascii_lowercase)


def upper() -> Node:
    return char_class(string.ascii_uppercase)


def line_end() -> Node:
    return NL.or_(end)


def line_start() -> Node:
    return NL.or_(start)


def lines() -> Node:
    """Lines with their newline; the last one ends with the text."""
    return start.to(line_end()).or_(NL.to(line_end(), skip_left=True))


def empty_lines() -> Node:
    return lines().in_or_equal(blank().concat())


def words() -> Node:
    return char_class(string.ascii_letters).concat()


def word_in(x) -> Node:
    return as_node(x).containing(words())


def all_text() -> Node:
    """Whole texts of two characters or more."""
    return start.to(end)


# Order and place
def regs_after(n: int, x, y) -> Node:
    """The first n regions of x after each of y."""
    x, y = as_node(x), as_node(y)
    return x.within(y.to(x.join(n)))


def regs_before(n: int, x, y) -> Node:
    x, y = as_node(x), as_node(y)
    return x.within(x.join(n).to(y))


def first_position(x) -> Node:
    return as_node(x).first_bytes(1)


def nth_in(n: int, x, y) -> Node:
    return as_node(x).nth_in(y, n)


def first_in(x, y) -> Node:
    return nth_in(1, x, y)


def second_in(x, y) -> Node:
    return nth_in(2, x, y)


def third_in(x, y) -> Node:
    return nth_in(3, x, y)


def last_in(x, y) -> Node:
    return nth_in(-1, x, y)


def followed_by(x, y) -> Node:
    """x and y with nothing between."""
    x, y = as_node(x), as_node(y)
    return x.to(y).not_containing(x.to(y, True, True))


# Markup
def elements_named(name: Node | str) -> Node:
    n = name.args[0] if isinstance(name, Node) else name
    return stag(n).to(etag(n))


def root_elements() -> Node:
    return elements.outer()


def parents(x) -> Node:
    return elements.parenting(as_node(x))


def children(x) -> Node:
    return elements.childrening(as_node(x))


def stags_of(x) -> Node:
    """Start tags directly in x, not in another element there."""
    return stag("*").or_(elements).childrening(as_node(x)).equal(stag("*"))


def etags_of(x) -> Node:
    """End tags that x ends with."""
    return etag("*").containing(as_node(x).last_bytes(1))


def having_parent(x, y) -> Node:
    x, y = as_node(x), as_node(y)
    return elements.or_(x).childrening(y).equal(x)


# Mailboxes: messages begin with "From ", at the text's start or in a line with the two colons of a time; headers
# end with an empty line.
def mail_start() -> Node:
    stamped = phrase("\nFrom ").extracting(NL).to(phrase(":")).to(phrase(":")).within(lines())
    return followed_by(phrase("F").in_or_equal(start), phrase("rom ")).or_(phrase("From ").within(stamped))


def mail_header_end() -> Node:
    return phrase("\n\n").or_(end)


def mail_header() -> Node:
    return mail_start().to(mail_header_end())


def mail_message() -> Node:
    s = mail_start()
    return s.to(s, skip_right=True).or_(s.to(end))


def mail_body() -> Node:
    return mail_message().extracting(mail_header())


def _mail_field(name: str) -> Node:
    """Lines that begin so, in headers or not, without the newline before."""
    key = phrase("\n" + name)
    return key.to(line_end()).extracting(NL.within(key))


def mail_from() -> Node:
    return _mail_field("From: ")


def mail_subject() -> Node:
    return _mail_field("Subject: ")


def mail_to() -> Node:
    """Recipients, continued lines included: up to the next line with a colon or the header's end."""
    key = phrase("\nTo: ")
    return key.to(lines().containing(phrase(":")).or_(mail_header_end()), skip_right=True).extracting(NL.within(key))


def mail_date() -> Node:
    return _mail_field("Date: ")


# News spools: articles begin at the text's start or with "From " after an empty line.
def news_start() -> Node:
    return start.or_(phrase("\n\nFrom ").last_bytes(5))


def news_article() -> Node:
    return news_start().to(news_start().or_(end), skip_right=True)


def news_header() -> Node:
    return news_start().to(NL.within(phrase("\n\n")))


def news_body() -> Node:
    return news_header().to(news_start().or_(end), skip_left=True)


def news_line(name: Node | str) -> Node:
    key = phrase("\n" + (name.args[0] if isinstance(name, Node) else name) + " ")
    return key.within(news_header()).extracting(NL.within(key)).to(line_end())


def news_from() -> Node:
    return news_line("From:")


def news_subject() -> Node:
    return news_line("Subject:")


def news_path() -> Node:
    return news_line("Path:")


def news_groups() -> Node:
    return news_line("Newsgroups:")


def news_date() -> Node:
    return news_line("Date:")


def news_organization() -> Node:
    return news_line("Organization:")


# C sources
def c_comments() -> Node:
    return phrase("/*").quote(phrase("*/"))


def c_preprocessor() -> Node:
    """Lines that begin with #, with their continuation lines."""
    begin = start.in_or_equal(phrase("#")).or_(phrase("\n#"))
    return begin.to(NL.not_in(phrase("\\\n")).or_(end))


def c_blocks() -> Node:
    return phrase("{").to(phrase("}")).not_in(c_comments())


def c_parentheses() -> Node:
    return phrase("(").to(phrase(")")).not_in(c_comments().or_(c_preprocessor()))


def c_functions() -> Node:
    """What lies between blocks, comments and directives and holds parentheses but no semicolon."""
    rest = all_text().extracting(c_blocks()).extracting(c_comments()).extracting(c_preprocessor())
    return rest.containing(c_parentheses()).not_containing(phrase(";"))


def c_control_lines() -> Node:
    """The contents of directives' lines."""
    return phrase("#").in_or_equal(start).or_(phrase("\n#")).to(NL.or_(end), skip_left=True)


def c_if_conditions() -> Node:
    return phrase("if").not_in(c_comments().or_(c_control_lines())).to(phrase("(").to(phrase(")")))


# Macro files
def macro_names() -> Node:
    """The names that a macro file defines: between the parenthesis of a definition and its comma."""
    defined = phrase("efine").not_in(phrase("(").to(phrase(")")))
    return defined.to(phrase("(")).to(phrase(",").to(phrase(")")), True, True)


#: Names in queries.
MACROS = {
    "MACRO_NAMES": macro_names,
    "NUMERAL": numeral, "BLANK": blank, "LOWER": lower, "UPPER": upper, "LEND": line_end, "LSTART": line_start, "LINE": lines, "LINES": lines, "ELINE": empty_lines,
    "REGS_AFTER": regs_after, "REGS_BEFORE": regs_before, "FIRST_I": first_position, "FIRST_IN": first_in, "SECOND_IN": second_in, "THIRD_IN": third_in, "LAST_IN": last_in, "FBY": followed_by, "NEXTTO": followed_by, "ALL": all_text, "WORDS": words, "WORD": word_in,
    "ELEMENTS": elements_named, "ROOT_ELEMENTS": root_elements, "PARENTS": parents, "CHILDREN": children, "STAGS_OF": stags_of, "ETAGS_OF": etags_of, "HAVING_PARENT": having_parent,
    "MAIL_HSTART": mail_start, "MAIL_HEND": mail_header_end, "MAIL_HEADER": mail_header, "MAIL_MESS": mail_message, "MAIL_BODY": mail_body, "MAIL_FROM": mail_from, "MAIL_SUBJ": mail_subject, "MAIL_TO": mail_to, "MAIL_DATE": mail_date,
    "NEWS_START": news_start, "NEWS_ARTICLE": news_article, "NEWS_HEADER": news_header, "NEWS_BODY": news_body, "NEWS_HLINE": news_line, "NEWS_FROM": news_from, "NEWS_SUBJ": news_subject, "NEWS_PATH": news_path, "NEWS_GROUPS": news_groups, "NEWS_DATE": news_date, "NEWS_ORG": news_organization,
    "C_COMMENTS": c_comments, "COMMENT": c_comments, "C_PREPROCS": c_preprocessor, "CTRLINE": c_control_lines, "C_BLOCKS": c_blocks, "BLOCK": c_blocks, "C_PAREN": c_parentheses, "C_FUNCS": c_functions, "IF_COND": c_if_conditions,
}
