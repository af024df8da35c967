"""HTML to text, and anchors out of HTML.

The column functions stay in the JVM and read the markup with regular
expressions.  :func:`parse_html` reads it with the standard library's parser,
which also gets right what a pattern cannot: ``>`` inside attributes, unclosed
elements and every entity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements dropped with their contents.
DROPPED_ELEMENTS = ("title", "script", "style", "meta")

# Fixed value: the blanks of Python's ``\s``.  Java's ASCII ``\s`` lacks those above
# U+007F, and its Unicode form lacks the four separators U+001C to U+001F.
_BLANKS = r"(?U)[\s\x1c-\x1f]{2,}"

# Character references: numeric ones, and names with or without a semicolon.  In an
# attribute a name without one counts only where no value can follow.
_REFERENCE = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z][-.a-zA-Z0-9]*;?)"
_ATTRIBUTE_REFERENCE = (
    r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?![=a-zA-Z0-9])))"
)

# What stands for a reference to no character.
_UNKNOWN = "\ufffd"

# A comment is matched first and kept, so that markup inside it stays a comment.
_DROP = r"(?is)(<!--.*?-->)" + "".join(
    rf"|<{name}\b.*?(?:</{name}\s*>|\z)" for name in DROPPED_ELEMENTS if name != "meta"
)
_TAG = r"<[^>]+>"

# Comments, scripts and styles are matched without a group, which hides their anchors.
_ANCHOR = (
    r"(?is)<!--.*?-->|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
    r"""|<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
)


def drop_elements(html: Column) -> Column:
    """Remove title, script and style with their contents (meta has none)."""
    return F.regexp_replace(html, F.lit(_DROP), F.lit("$1"))


def strip_tags(html: Column, replacement: str = "") -> Column:
    """Remove tags, comments and doctype; by default the words around a tag are glued."""
    return F.regexp_replace(html, F.lit(_TAG), F.lit(replacement))


def collapse_blanks(text: Column) -> Column:
    """Runs of two or more blanks become one space; a single blank stays as it is."""
    return F.regexp_replace(text, F.lit(_BLANKS), F.lit(" "))


# Ends an entry of a table of names, and parts a name from its value.
_ENTRY, _IS = "\x01", "\x02"

# Names that most references have; they stand first in their table.
_COMMON = ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot")


def _table(names: dict[str, str]) -> str:
    """All names with their values in one text, so that a lookup is a small expression."""
    ordered = sorted(names, key=lambda n: (n not in _COMMON, n))
    return _ENTRY + "".join(f"{name}{_IS}{names[name]}{_ENTRY}" for name in ordered)


def _lookup(name: Column, table: str) -> Column:
    """The value of a name, null for none."""
    at = F.instr(F.lit(table), F.concat(F.lit(_ENTRY), name, F.lit(_IS)))
    # No value has more than two characters.
    value = F.substring(F.lit(table), at + F.char_length(name) + 2, F.lit(3))
    return F.when(at > 0, F.substring_index(value, _ENTRY, 1))


# The standard names, without their semicolons, and the old ones that need none.
_NAMES = _table({name[:-1]: value for name, value in entities.html5.items() if name.endswith(";")})
_OLD_NAMES = _table({name: value for name, value in entities.html5.items() if not name.endswith(";")})


def _windows_1252(code: int) -> str:
    try:
        return bytes([code]).decode("windows-1252")
    except UnicodeDecodeError:
        return _UNKNOWN


# 128 to 159 mean Windows-1252 in practice.
_CONTROLS = {code: _windows_1252(code) for code in range(128, 160)}


def _numbered(reference: Column) -> Column:
    """The character of ``&#65;`` or ``&#x41;``; U+FFFD where there is none."""
    digits = F.regexp_extract(reference, r"&#[xX]?([0-9a-fA-F]+)", 1)
    is_hex = F.rlike(reference, F.lit("^&#[xX]"))
    code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    controls = F.create_map(*[x for k, v in _CONTROLS.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    is_character = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    valid = F.when(F.coalesce(is_character, F.lit(False)), code).otherwise(0xFFFD)
    text = F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), F.try_element_at(controls, code)).otherwise(text)


def _replaced(text: Column, pattern: str, replace, rest) -> Column:
    """``text`` with ``replace`` of each match of ``pattern`` and ``rest`` of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    pairs = F.zip_with(
        between,
        F.concat(F.transform(found, replace), F.array(F.lit(""))),
        lambda plain, reference: F.concat(rest(plain), reference),
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(pairs, "")).otherwise(rest(text))


def _escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _decoded_reference(reference: Column) -> Column:
    """The character of a reference in text; an unknown name stays, without its semicolon."""
    name = F.regexp_replace(reference, "[&;]", "")
    return F.when(F.startswith(reference, F.lit("&#")), _numbered(reference)).otherwise(
        F.coalesce(_lookup(name, _NAMES), F.concat(F.lit("&"), name))
    )


def _attribute_reference(reference: Column) -> Column:
    """The same in an attribute, where an unknown name stays as it is."""
    name = F.regexp_replace(reference, "[&;]", "")
    closed = F.endswith(reference, F.lit(";"))
    known = F.when(closed, _lookup(name, _NAMES)).otherwise(_lookup(name, _OLD_NAMES))
    return F.when(F.startswith(reference, F.lit("&#")), _numbered(reference)).otherwise(
        F.coalesce(known, reference)
    )


def escape_references(html: Column) -> Column:
    """Every character reference as its character, ``& < >`` as ``&amp; &lt; &gt;``.

    Done before tags are stripped, as the next word would be glued to a name
    without a semicolon; a bare ampersand is escaped too.
    """
    return _replaced(
        html,
        _REFERENCE,
        lambda reference: _escaped(_decoded_reference(reference)),
        lambda plain: F.replace(plain, F.lit("&"), F.lit("&amp;")),
    )


def unescape(text: Column) -> Column:
    """The text that ``&amp; &lt; &gt;`` of cleaned text stand for."""
    for char, name in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def page_text(
    html: Column,
    decode: bool = False,
    tag_replacement: str = "",
    decode_amp: bool = False,
) -> Column:
    """Clean text of a page, in the JVM."""
    kept = drop_elements(html)
    if decode or decode_amp:
        kept = escape_references(kept)
    text = strip_tags(kept, tag_replacement)
    return collapse_blanks(unescape(text) if decode_amp else text)


def page_hrefs(html: Column) -> Column:
    """The href of each anchor in page order, in the JVM; anchors without one are skipped."""
    quoted = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1))

    def value(raw: Column) -> Column:
        bare = F.when(
            F.substring(raw, 1, 1).isin('"', "'"), F.substring(raw, F.lit(2), F.char_length(raw) - 2)
        ).otherwise(raw)
        return _replaced(bare, _ATTRIBUTE_REFERENCE, _attribute_reference, lambda plain: plain)

    return F.transform(F.filter(quoted, lambda raw: raw != ""), value)


def decode_page(body: Column) -> Column:
    """UTF-8 text of a fetched body, or null where the bytes are not UTF-8."""
    return F.try_validate_utf8(body.cast("string"))


def repair_page(body: Column) -> Column:
    """UTF-8 text of a fetched body, bad bytes replaced by U+FFFD."""
    return F.make_valid_utf8(body.cast("string"))


def code_is_none(char: str) -> bool:
    """Whether ``char`` is no character: NUL, or half of a surrogate pair."""
    return char == "\0" or "\ud800" <= char <= "\udfff"


class _PageReader(HTMLParser):
    """Collects a page's escaped text and its hrefs in one pass."""

    # Elements that never hold content.
    VOID = frozenset(
        "area base br col embed hr img input keygen link menuitem meta param source track wbr "
        "basefont bgsound command frame image isindex nextid spacer".split()
    )

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.text: list[str] = []
        self.hrefs: list[str] = []
        self.open: list[str] = []
        self.open_count: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = next((v for k, v in reversed(attrs) if k == "href"), None)
            if any(k == "href" for k, _ in attrs):
                self.hrefs.append(href or "")
        if tag not in self.VOID:
            self.open.append(tag)
            self.open_count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        closed = None
        while self.open_count[tag] and closed != tag:
            closed = self.open.pop()
            self.open_count[closed] -= 1

    def keep(self, piece: str) -> None:
        if not any(self.open_count[tag] for tag in DROPPED_ELEMENTS):
            self.text.append(piece)

    def handle_data(self, data):
        self.keep(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            # 128-159 mean Windows-1252 in practice.
            char = _CONTROLS[code] if 128 <= code < 160 else chr(code)
        except (ValueError, OverflowError):
            char = _UNKNOWN
        if code_is_none(char):
            char = _UNKNOWN
        self.handle_data(char)

    def handle_entityref(self, name):
        self.handle_data(entities.html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self.keep(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.keep(f"<!{decl}>")

    def unknown_decl(self, data):
        self.keep(f"<![{data}]>")

    def handle_pi(self, data):
        self.keep(f"<?{data}>")


PARSED_PAGE = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("hrefs", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def _parse(html: str | None) -> tuple[str | None, list[str] | None, str | None]:
    """Text, hrefs and, for a page that the parser refuses, why."""
    if html is None:
        return None, None, None
    reader = _PageReader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError) as error:
        return None, None, f"{type(error).__name__}: {error}"
    text = re.sub(r"<[^>]+>", "", "".join(reader.text))
    return re.sub(r"\s{2,}", " ", text), reader.hrefs, None


@F.pandas_udf(PARSED_PAGE)
def parse_html(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Text and hrefs of each page, read by a parser; one pass, Arrow batches."""
    for html in pages:
        yield pd.DataFrame([_parse(page) for page in html], columns=["content", "hrefs", "error"])


# Markup that patterns read as a parser does.  Comments without angle brackets, tags
# whose attributes hold none, and doctypes; possessive, so that nothing is tried twice.
_PLAIN_COMMENT = r"<!--(?!-?>)[^<>]*+(?<=--)>"
_PLAIN_TAG = (
    r"</?[a-zA-Z][a-zA-Z0-9]*+(?:\s++[a-zA-Z_][-\w:.]*+"
    r"""(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+\s*+/?>"""
    r"|<!(?i:doctype)[^<>]*+>"
)

# Elements with rules of their own; dropped ones that are not closed, or not plainly;
# a title with markup in it.
_OTHER_RULES = (
    r"(?is)<(?:textarea|iframe|xmp|noembed|noframes|noscript|plaintext|listing|svg|math)\b"
    r"|</(?:title|script|style)(?!\s*>)"
    r"|<(title|script|style)\b(?!.*</\1\s*>)"
    r"|<title\b[^>]*>[^<]*+<(?!/title\s*>)"
    # A reference that the page's end cuts off.
    r"|&[#\w]*+\z"
)


def plain_markup(html: Column) -> Column:
    """Whether the patterns read a page as the parser does; null for no page.

    What is left when comments, dropped elements and tags of plain form are taken
    out must hold no angle bracket.  NUL and lone carriage returns are not plain.
    """
    # A blank stands for what is taken out, so that its neighbours make no tag.
    bare = F.regexp_replace(html, F.lit(_PLAIN_COMMENT), F.lit(" "))
    left = F.regexp_replace(bare, F.lit(_DROP), F.lit(" "))
    left = F.regexp_replace(left, F.lit(_PLAIN_TAG), F.lit(" "))
    return ~F.rlike(left, F.lit("[<>\0]")) & ~F.rlike(bare, F.lit(_OTHER_RULES)) & ~F.contains(bare, F.lit("<!--"))


def exact_text(html: Column) -> Column:
    """(content, error) of a page: by pattern where its markup is plain, else by parser.

    Only pages whose markup is not plain go to Python.  A page that the parser
    refuses has no content, and ``error`` says why.
    """
    plain = F.coalesce(plain_markup(html), F.lit(True))
    parsed = parse_html(F.when(~plain, html))
    return F.struct(
        F.when(plain, page_text(html, decode=True)).otherwise(parsed["content"]).alias("content"),
        F.when(~plain, parsed["error"]).alias("error"),
    )
