"""What a line of text looks like, as column expressions that stay inside generated code.

Lengths count bytes, letters fold in ASCII only, as the formats define it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STREETS = ("street", "avenue", "road", "tel:", "phone", "boulevard", "blvd", "lane", "drive", "place", "way ", "court", "suite", "wharf", "plaza", "square")
INSTITUTES = ("institute", "department", "university", "laboratory", "school")
BODY = "Text_20_body"


def ascii_lower(t: Column) -> Column:
    return F.translate(t, UPPER, LOWER)


def any_of(t: Column, words: tuple[str, ...]) -> Column:
    low = ascii_lower(t)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def starts_folded(t: Column, prefix: str) -> Column:
    return F.startswith(ascii_lower(t), F.lit(prefix.lower()))


def size(t: Column) -> Column:
    return F.octet_length(t)


def recital(t: Column) -> Column:
    return t.rlike(r"^\([0-9]+\) ")


def email_line(t: Column) -> Column:
    return size(t).between(1, 160) & F.contains(t, F.lit("@")) & F.contains(t, F.lit("."))


def date_line(t: Column) -> Column:
    return size(t).between(8, 64) & t.rlike("[0-9]") & any_of(t, MONTHS)


def author_line(t: Column) -> Column:
    return size(t).between(8, 80) & ~F.contains(t, F.lit("@")) & F.contains(t, F.lit(",")) & any_of(t, (" and ",))


def address_line(t: Column) -> Column:
    numbers = (F.contains(t, F.lit(",")) & t.rlike("[0-9]")) | t.rlike("[0-9]{4}")
    return size(t).between(1, 96) & ~date_line(t) & (any_of(t, STREETS) | numbers)


def paragraph_style(t: Column) -> Column:
    """Style of a paragraph of one text run (null for others): the first that fits."""
    style = (
        F.when(t.isNull(), BODY)
        .when(t == "---", "OJSeparator")
        .when(t == "Whereas:", "OJWhereasLabel")
        .when(t == "For the Commission", "OJSignatureLine")
        .when(t == "The President", "OJSignatureTitle")
        .when(recital(t), "OJRecital")
        .when(F.startswith(t, F.lit("Dear ")), "LetterSalutation")
        .when(t.isin("Sincerely,", "Sincerely"), "LetterClosing")
        .when(reduce(lambda a, b: a | b, (F.startswith(t, F.lit(p)) for p in ("By email:", "By Email:", "CC:", "Cc:"))), "EmailLine")
        .when(date_line(t), "DateLine")
        .when(address_line(t), "Affiliation")
        .when(email_line(t), "EmailLine")
        .when((size(t) <= 60) & any_of(t, INSTITUTES), "Affiliation")
        .when(any_of(t, ("this abstract", "the abstract should")), "AbstractParagraph")
        .when(author_line(t), "AuthorLine")
    )
    return style.otherwise(BODY)


# lines of Markdown


def fence(line: Column) -> Column:
    return F.startswith(line, F.lit("```"))


def structured(line: Column) -> Column:
    return line.rlike(r"^ *(?:[#|>`:]|[-*] |[0-9]+\. )")


def has_url(line: Column) -> Column:
    return F.contains(line, F.lit("http://")) | F.contains(line, F.lit("https://"))


def toc_link(line: Column) -> Column:
    return F.startswith(line, F.lit("[")) & F.contains(line, F.lit("](#__RefHeading"))


STAGES = ("This stage:", "Previous stage:", "Latest stage:")


def stage_label(line: Column) -> Column:
    return line.isin(*STAGES)


def stage_link(line: Column) -> Column:
    return F.startswith(line, F.lit("[")) & F.contains(line, F.lit("docs.oasis-open.org/office/OpenDocument/"))


def caption(line: Column) -> Column:
    return F.startswith(line, F.lit("Table")) & F.contains(line, F.lit(" - "))


def list_marker(line: Column) -> Column:
    return line.rlike(r"^(?:[-*]|[0-9]+\.) ")


def delimiter(line: Column) -> Column:
    return line.rlike(r"^[-:| \t]*-[-:| \t]*$")


def line_class(line: Column) -> Column:
    """Class of a line without its indent, in the order in which the block parser asks."""
    return (
        F.when(line == "", "blank")
        .when(line.rlike(r"^:::.+"), "directive")
        .when(fence(line), "fence")
        .when(F.startswith(line, F.lit(">")), "quote")
        .when(line.rlike("^#{1,6} "), "heading")
        .when(F.startswith(line, F.lit("|")), "pipe")
        .when(line.rlike("^[-*] "), "bullet")
        .when(line.rlike(r"^[0-9]+\. "), "ordered")
        .otherwise("paragraph")
    )


# text


def escape(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("<"), F.lit("\\<")), F.lit(">"), F.lit("\\>"))


def flatten(t: Column) -> Column:
    return F.translate(t, "\n\r\t", "   ")


def escape_flat(t: Column) -> Column:
    return escape(F.replace(flatten(t), F.lit("|"), F.lit("\\|")))


def xml_escape(t: Column, attribute: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&apos;")) if attribute else ())):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def raw_tags(t: Column) -> Column:
    """How many <name> stand in a text without a backslash before them."""
    return F.regexp_count(t, F.lit(r"(?<!\\)<[A-Za-z0-9:_-]+>"))


def unsafe_name(name: Column) -> Column:
    """Entry names that are absolute or climb out."""
    return name.rlike(r"^[/\\]|(^|[/\\])\.\.([/\\]|$)")


#: Media types by the end of a name.
MEDIA_TYPES = ((".xml", "text/xml"), (".png", "image/png"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".gif", "image/gif"), (".svg", "image/svg+xml"), (".bin", "application/octet-stream"))


def media_type(name: Column) -> Column:
    """Media type of a package entry by its name."""
    out = F.lit("")
    for end, kind in reversed(MEDIA_TYPES):
        out = F.when(F.endswith(name, F.lit(end)), kind).otherwise(out)
    return out


# code points


def code_points(t: Column) -> Column:
    """Code points of a text, from its UTF-32 form."""
    hexa = F.hex(F.encode(t, "UTF-32"))
    n = F.length(t)
    one = lambda i: F.conv(F.substring(hexa, i * 8 + 1 + F.length(hexa) - n * 8, F.lit(8)), 16, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def utf8_bytes(cp: Column) -> Column:
    """UTF-8 form of one code point; null for surrogates and beyond the last."""
    good = (cp >= 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    low = lambda k: F.lpad(F.hex(F.lit(0x80) + F.shiftright(cp, 6 * k) % 64), 2, "0")
    text = (
        F.when(cp < 0x80, F.lpad(F.hex(cp), 2, "0"))
        .when(cp < 0x800, F.concat(F.hex(F.lit(0xC0) + F.shiftright(cp, 6)), low(0)))
        .when(cp < 0x10000, F.concat(F.hex(F.lit(0xE0) + F.shiftright(cp, 12)), low(1), low(0)))
        .otherwise(F.concat(F.hex(F.lit(0xF0) + F.shiftright(cp, 18)), low(2), low(1), low(0)))
    )
    return F.when(good, F.unhex(text))


def xml_blank(t: Column) -> Column:
    return t.rlike(r"\A[ \t\n\r]*\z")


def xml_name(t: Column) -> Column:
    """Whether a text is a name: ASCII letters, _ and : and all beyond ASCII, behind the first also digits, - and dots."""
    return t.rlike(r"\A[A-Za-z_:\x{80}-\x{10FFFF}][A-Za-z_:0-9.\x{80}-\x{10FFFF}-]*\z")


def local_name(t: Column) -> Column:
    """A qualified name without its prefix."""
    return F.element_at(F.split(t, ":", 2), -1)
