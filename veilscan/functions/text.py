"""Text of pages and pieces of text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a recognizer reads, its window and overlap, windows it reads, characters of a preview.
MOST, WIDTH, OVERLAP, WINDOWS, PREVIEW = 20_000, 1_200, 120, 20, 2_000

#: Named entities.
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _decoded(x: Column) -> Column:
    """Numeric entities as their characters, beyond the basic plane too; what is no code point becomes a space."""
    parts = F.split(x, r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});", -1)
    found = F.regexp_extract_all(x, F.lit(r"&#((?:[xX][0-9A-Fa-f]{1,6})|(?:[0-9]{1,7}));"), F.lit(1))

    def char(e: Column) -> Column:
        hexa = F.lower(e).startswith("x")
        n = F.when(hexa, F.conv(F.substring(e, 2, 8), 16, 10)).otherwise(e).cast("int")
        fits = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit(" "))

    made = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(char(F.get(found, i)), F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(made, "")).otherwise(x)


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, tags become spaces, entities their characters, white space one space."""
    x = html
    for tag in ("script", "style"):
        x = F.regexp_replace(x, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for name, char in NAMED.items():
        if name != "&amp;":
            x = F.regexp_replace(x, f"(?i){name}", char)
    x = F.regexp_replace(_decoded(x), "(?i)&amp;", "&")
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def chunks(text: Column, windows: int | None = None) -> Column:
    """Overlapping windows of a whole text: number, start, text, partial. With at most ``windows`` of them (a recognizer reads ``WINDOWS``), a tail beyond makes each of them partial."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - OVERLAP - 1, F.lit(0)), F.lit(WIDTH - OVERLAP))
    partial = F.lit(False) if windows is None else F.size(starts) > windows
    starts = starts if windows is None else F.slice(starts, 1, windows)
    return F.transform(starts, lambda s, i: F.struct(i.alias("number"), s.alias("start"), F.substring(text, s + 1, WIDTH).alias("text"), partial.alias("partial")))


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code point offset in UTF-16 units: characters beyond the basic plane count twice."""
    return offset + F.regexp_count(F.substring(text, 1, offset), F.lit("[\\x{10000}-\\x{10FFFF}]"))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    common = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return common / (a_end - a_start + b_end - b_start - common)
