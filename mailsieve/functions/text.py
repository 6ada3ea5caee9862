"""Text cleaning as column expressions that stay in the JVM, plus one Arrow UDF for odd markup."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.arrays import bind

# The code points Python's ``\s`` matches, in the syntax Java and RE2 share.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
URL_PATTERN = rf"(?iu)(?:https?://|www\.)[^{WS}]+"
URL_TOKEN = " <URL> "
# What every match of the pattern has, in either case.
_URL_SIGNS = ("://", "ww.", "wW.", "Ww.", "WW.")

# Elements whose text is not part of the visible message.
_HIDDEN = ("script", "style", "template")
# Every alternative starts with "<", so other characters are passed over quickly. A ">" inside a quoted value, which a "=" opens,
# does not end a start tag; where quotes are unbalanced the first ">" does. Possessive repeats
# keep the matcher from recursing on long tags. A place that fails has been read to the next "<" only, and behind
# ``_guard_open`` each other alternative finds its end, so the matcher's work grows with the text and no faster.
_MARKUP = (
    r"(?is)<(?:!--.*?-->"
    + "".join(rf"|{tag}\b.*?(?:</{tag}[^>]*+>|\z)" for tag in _HIDDEN)
    + rf"""|[a-z][^>"'=<]*+(?:(?:=[{WS}]*+(?:"[^"]*+"|'[^']*+')|["'=])[^>"'=<]*+)*+>|[a-z/!?][^>]*+>)"""
)
_NODE_BREAK = "\x01"
# Stands for a "<" that opens nothing. It is no character, so no text has it.
_PLAIN_OPEN = "\uffff"

# Names that are entities even without the closing semicolon, longest first so that the
# longest one wins; both tables come from the standard library.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE_PATTERN = "^(" + "|".join(_BARE) + ")"
_NAMED = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}
# Looked up first: a lookup walks its table, and nearly all mail uses these only.
_COMMON = (
    "amp lt gt quot apos nbsp copy reg trade middot bull hellip mdash ndash lsquo rsquo ldquo "
    "rdquo laquo raquo euro pound yen cent sect deg times eacute egrave agrave ccedil uuml ouml "
    "auml szlig ntilde zwnj zwj shy"
).split()
# Codes 128 to 159 are read as Windows-1252, as browsers do; its five gaps stay as they are.
_WINDOWS = [ord(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(128, 160)]


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(text: Column | str) -> Column:
    """A null message counts as the empty one (single-message calls)."""
    return F.coalesce(_as_col(text), F.lit(""))


def text_or_nan(text: Column | str) -> Column:
    """A null message becomes the word ``nan`` (whole-corpus calls)."""
    return F.coalesce(_as_col(text).cast("string"), F.lit("nan"))


def _char(code: Column) -> Column:
    """Unicode code point to a string of one character, or of none for control codes and non-characters.

    A null code stands for a number too long to be a code point.
    """
    known = (
        F.when(code.between(128, 159), F.get(F.array(*map(F.lit, _WINDOWS)), (code - 128).cast("int")))
        .when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code)
        .otherwise(0xFFFD)
    )
    silent = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
        | code.between(0xFDD0, 0xFDEF) | ((code.bitwiseAND(0xFFFE) == 0xFFFE) & (code <= 0x10FFFF))
    )
    char = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
    return F.when(F.coalesce(silent, F.lit(False)), "").otherwise(char)


def _code(digits: Column, base: int, places: int) -> Column:
    """The number, or null when it has more than ``places`` digits after leading zeros."""
    short = F.regexp_replace(digits, "^0+", "")
    return F.when(F.length(short) <= places, F.conv(F.concat(F.lit("0"), short), base, 10).cast("bigint"))


def _constant_map(table: dict[str, str]) -> Column:
    """A folded literal map, built in one call."""
    text = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02"))


def _decode_piece(piece: Column) -> Column:
    """Decode the reference that the text following one ``&`` may start with."""
    common_map = _constant_map({n: _NAMED[n] for n in _COMMON})
    named_map = _constant_map({n: v for n, v in _NAMED.items() if n not in _COMMON})
    bare_map = _constant_map({n: html5[n] for n in _BARE})
    dec = F.regexp_extract(piece, r"^#([0-9]+);?", 1)
    hexa = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
    full = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
    short = F.regexp_extract(piece, _BARE_PATTERN, 1)
    rest_of = lambda n: F.substring(piece, n + 1, F.length(piece))
    rest = F.regexp_replace(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
    named = lambda table: F.concat(F.element_at(table, full), rest_of(F.length(full) + 1))
    return (
        F.when(~F.regexp_like(piece, F.lit("^[#A-Za-z]")), F.concat(F.lit("&"), piece))
        .when(dec != "", F.concat(_char(_code(dec, 10, 7)), rest))
        .when(hexa != "", F.concat(_char(_code(hexa, 16, 6)), rest))
        .when(F.map_contains_key(common_map, full), named(common_map))
        .when((full != "") & F.map_contains_key(named_map, full), named(named_map))
        .when(short != "", F.concat(F.element_at(bare_map, short), rest_of(F.length(short))))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape_entities(text: Column | str) -> Column:
    """Decode numeric and named character references, as the standard library does."""
    parts = F.split(_as_col(text), "&", -1)
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p)))
    return F.array_join(decoded, "")


def strip_space(text: Column) -> Column:
    """Trim every kind of white space Python's ``str.strip`` trims."""
    return F.trim(text, F.lit(_SPACE_CHARS))


def _has_markup(text: Column) -> Column:
    return F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))


def _drop_markup(text: Column, node_break: str) -> Column:
    """Decode references, put ``node_break`` in place of markup, decode again.

    Plain messages, most of the mail, skip all three steps.
    """
    guarded = bind(unescape_entities(text), _guard_open)
    plain = F.replace(F.regexp_replace(guarded, _MARKUP, node_break), F.lit(_PLAIN_OPEN), F.lit("<"))
    return F.when(_has_markup(text), unescape_entities(plain)).otherwise(text)


def _until_last(text: Column, end: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the text up to its last ``end`` and of what follows, which is the whole text where it has none."""
    rest = F.substring_index(text, end, -1)
    return bind(rest, lambda r: body(F.left(text, F.char_length(text) - F.char_length(r)), r))


def _guard_open(text: Column) -> Column:
    """The text with every "<" marked as plain that no ">" follows, and every "<!--" that no "-->" follows."""
    comments = lambda head: _until_last(head, "-->", lambda a, b: F.concat(a, F.replace(b, F.lit("<!--"), F.lit(_PLAIN_OPEN + "!--"))))
    marked = lambda head, rest: F.concat(bind(head, comments), F.replace(rest, F.lit("<"), F.lit(_PLAIN_OPEN)))
    return _until_last(text, ">", marked)


def html_to_text(text: Column | str) -> Column:
    """Visible text: decode references, drop markup, decode again, one space between text nodes.

    Works without Python, in time that grows with the text. A tag or comment that is never closed stays as text. It differs from a real HTML parser
    only where a quoted value is never closed (the tag ends at its first ``>``), a tag with quotes holds a ``<`` outside them, in marked
    sections, and at a ``<`` that stays text, which doesn't end a text node here.
    """
    nodes = F.split(_drop_markup(text_or_empty(text), _NODE_BREAK), _NODE_BREAK, -1)
    return F.array_join(F.filter(F.transform(nodes, strip_space), lambda n: n != ""), " ")


class _VisibleText(HTMLParser):
    """Collects the stripped text nodes outside hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.nodes.append(data.strip())


def _parse(text: str) -> str:
    parser = _VisibleText()
    parser.feed(html.unescape(text))
    parser.close()
    return " ".join(parser.nodes)


@F.pandas_udf(T.StringType())
def _parse_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_parse, na_action="ignore")


def html_to_text_exact(text: Column | str) -> Column:
    """As :func:`html_to_text` through a real parser; only rows with markup cross to Python."""
    text = text_or_empty(text)
    return F.coalesce(_parse_batch(F.when(_has_markup(text), text)), strip_space(text))


def mask_urls(text: Column | str) -> Column:
    """Every URL-like run becomes the marker ``<URL>`` with a space on each side.

    A run has one of ``_URL_SIGNS``; texts without, most of the mail, skip the pattern, which tries both cases at every place.
    """

    def masked(t: Column) -> Column:
        signs = [F.contains(t, F.lit(sign)) for sign in _URL_SIGNS]
        return F.when(reduce(or_, signs), F.regexp_replace(t, URL_PATTERN, URL_TOKEN)).otherwise(t)

    return bind(_as_col(text), masked)


def filter_charset(text: Column | str) -> Column:
    """Everything but ASCII letters, digits, ``<>@._`` and white space becomes a space."""
    return F.regexp_replace(_as_col(text), rf"[\W&&[^<>@.{WS}]]", " ")


def squeeze_lower(text: Column | str) -> Column:
    """One space between words, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(_as_col(text), rf"[{WS}]+", " ")))


def clean_text(text: Column | str, exact_html: bool = False) -> Column:
    """The cleaning every model input goes through: markup, URLs, character set, spacing.

    Not idempotent: the output holds ``<url>``, which a second pass would drop as a tag.
    """
    # Spacing between text nodes is squeezed below, so the plain form need not trim them.
    visible = html_to_text_exact(text) if exact_html else _drop_markup(text_or_empty(text), " ")
    # One pass does the work of filter_charset and squeeze_lower together.
    # (\W is ASCII only; in Java the intersection is several times faster than listing ranges.)
    kept = F.regexp_replace(mask_urls(visible), r"[\W&&[^<>@.]]+", " ")
    return F.lower(F.trim(kept))


def clean_text_simple(text: Column | str) -> Column:
    """The light cleaning: tags vanish without a space, white space squeezed, lower case."""
    # Behind the last ">" nothing is a tag, so no "<" there is tried.
    drop = lambda head, rest: F.concat(F.regexp_replace(head, r"<[^>]++>", ""), rest)
    return squeeze_lower(bind(text_or_empty(text), lambda t: _until_last(t, ">", drop)))


def text_preview(text: Column | str, max_len: int = 120) -> Column:
    text = _as_col(text)
    cut = F.concat(F.substring(text, 1, max_len), F.lit("..."))
    return F.when(F.length(text) > max_len, cut).otherwise(text)


def text_length(text: Column | str) -> Column:
    return F.length(_as_col(text))


def not_blank(text: Column | str) -> Column:
    """True when the message has something besides white space."""
    return F.coalesce(F.regexp_like(_as_col(text), F.lit(rf"[^{WS}]")), F.lit(False))


# Phrase lists of the indicator counts.
URGENT_PHRASES = ("urgent", "immediate", "act now", "limited time")
LEGITIMATE_PHRASES = ("order", "tracking", "customer", "service")
SUSPICIOUS_PHRASES = ("verify", "click here", "suspended", "limited")


def _phrases_present(text: Column, phrases: tuple[str, ...]) -> Column:
    hits = [F.contains(text, F.lit(p)).cast("int") for p in phrases]
    return sum(hits[1:], hits[0])


def indicator_counts(text: Column | str) -> Column:
    """struct of URL-bearing words and of distinct phrases present from the three lists."""
    text = text_or_empty(text)
    lowered = F.lower(text)
    url_words = F.filter(F.split(text, rf"[{WS}]+"), lambda w: F.contains(w, F.lit("http")))
    return F.struct(
        F.size(url_words).alias("url_count"),
        _phrases_present(lowered, URGENT_PHRASES).alias("urgent_words"),
        _phrases_present(lowered, LEGITIMATE_PHRASES).alias("legitimate_indicators"),
        _phrases_present(lowered, SUSPICIOUS_PHRASES).alias("suspicious_indicators"),
    )
