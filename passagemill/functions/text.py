"""Text as Column expressions: mark-up to plain text, tokens, overlap and chunk splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.vectors import let

_EDGES = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"
#: End tags that break a line.  A name matches by prefix, so </pre> breaks too.
BREAKING = ("article", "br", "div", "h[1-6]", "li", "p", "section", "tr")
_BREAK = "(?i)</(?:" + "|".join(BREAKING) + ")[^>]*>"
#: In the order in which they are replaced; the ampersand goes last so that nothing is decoded twice.
NAMED = (("&nbsp;", " "), ("&apos;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
LONGEST_TOKEN = 40
HEADING_LIMIT = 120


def strip_space(c: Column) -> Column:
    """Without white space of any alphabet, byte-order marks included, at either end."""
    return F.regexp_replace(c, _EDGES, "")


def decode_entities(c: Column) -> Column:
    """Named entities, then decimal ones; other forms stay as they are."""
    for name, sign in NAMED:
        c = F.replace(c, F.lit(name), F.lit(sign))
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(\d{1,7});"), F.lit(1)))

    def one(text: Column, code: Column) -> Column:
        n = code.cast("int")
        sign = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        bad = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        return F.when(bad, text).otherwise(F.replace(text, F.concat(F.lit("&#"), code, F.lit(";")), sign))

    return F.when(F.contains(c, F.lit("&#")), F.aggregate(codes, c, one)).otherwise(c)


def html_to_text(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    c = F.regexp_replace(c, _BREAK, "\n")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = decode_entities(F.regexp_replace(c, "<[^>]+>", ""))
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip_space(F.regexp_replace(c, " *\n *", "\n"))


def heading(html: Column) -> Column:
    """The first top heading on one line, or null if there is none of a usable length."""
    inner = F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)
    line = strip_space(F.regexp_replace(html_to_text(inner), r"(?U)\s+", " "))
    return F.when(F.length(line).between(1, HEADING_LIMIT), line)


def tokens(text: Column) -> Column:
    """Search tokens: lower-case runs of letters and digits, up to 40 characters."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: F.length(t).between(1, LONGEST_TOKEN))


def overlap_tail(text: Column, overlap: int) -> Column:
    tail = F.right(text, F.lit(overlap))
    space = F.instr(tail, " ")
    return F.when(F.length(text) <= overlap, text).when(space == 0, tail).otherwise(F.substr(tail, space + 1))


def split_to_budget(text: Column, budget: int, overlap: int) -> Column:
    """Passages of about budget characters: whole paragraphs packed, long ones cut, tails carried over.

    A fold over paragraphs; the cutting of an overlong run has a closed form.
    """
    step, most = budget - overlap, int(budget * 1.5)
    paragraphs = F.filter(F.transform(F.split(text, "\n{2,}"), strip_space), lambda p: p != "")
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def fold(acc: Column, p: Column) -> Column:
        flush = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) + 1 > budget)
        kept = F.when(flush, overlap_tail(acc["cur"], overlap)).otherwise(acc["cur"])
        out = F.when(flush, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        joined = let(kept, lambda k: F.when(k == "", p).otherwise(F.concat(k, F.lit("\n"), p)))

        def cut(cur: Column) -> Column:
            many = F.greatest(F.lit(0), F.ceil((F.length(cur) - most) / step).cast("int"))
            pieces = F.when(many > 0, F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), lambda i: F.substr(cur, i * step + 1, F.lit(budget)))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.substr(cur, many * step + 1).alias("cur"), F.concat(out, pieces).alias("out"))

        return let(joined, cut)

    def finish(acc: Column) -> Column:
        return F.when(strip_space(acc["cur"]) != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    return F.aggregate(paragraphs, zero, fold, finish)
