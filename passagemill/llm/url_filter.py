"""Operator 2: URL filters whose pattern rules are indexed by their rarest literal token.

A rule is a regular expression.  Parsing it yields, for each of its alternatives, the literal
tokens (runs of letters and digits with a boundary on either side) that any matching URL must
hold.  Every alternative is indexed by that token of its own that the fewest URLs hold, counted
over all URLs.  A URL's tokens fetch candidate rules, and only those run their expressions;
a rule with an alternative that holds no certain token is tried on every URL.  Rules are a table
(rule_id, pattern, action); they are parsed where they lie, and no part of them is collected.

Defined results: a null URL matches nothing and an empty one only rules that match the empty
text; rows repeated under one page_id give each rule once, and so do repeated rules; rows with a
null page_id are kept under null; a rule with a null id or pattern matches nothing, and one that
is no expression is an error; ties in rarity go to the longer, then the first token; URLs of any
length are read whole; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, written

_TOKEN = r"[^a-z0-9]+"


def _plain(code: int) -> bool:
    return code < 128 and chr(code).isalnum()


def _edge(item) -> bool:
    """Whether this element of a pattern is never a letter or digit, nor empty, or is an anchor."""
    op, arg = item
    if op is sre.LITERAL:
        return arg < 128 and not _plain(arg)
    if op is sre.AT:
        return arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END_STRING, sre.AT_BOUNDARY)
    if op is sre.IN:
        return all(o is sre.LITERAL and a < 128 and not _plain(a) for o, a in arg)
    if op is sre.MAX_REPEAT or op is sre.MIN_REPEAT:
        low, _, inner = arg
        return low > 0 and len(inner) == 1 and _edge(inner[0])
    return False


def _flat(seq) -> list:
    out = []
    for op, arg in seq:
        if op is sre.SUBPATTERN and arg[1] == arg[2] == 0 and not any(o is sre.BRANCH for o, _ in arg[3]):
            out += _flat(arg[3])
        else:
            out.append((op, arg))
    return out


def required_tokens(pattern: str) -> list[list[str]]:
    """For each alternative of the pattern, the tokens that a match must hold, in order."""
    tree = list(_parser.parse(pattern))
    while len(tree) == 1 and tree[0][0] is sre.SUBPATTERN and not (tree[0][1][1] or tree[0][1][2]):
        tree = list(tree[0][1][3])
    branches = tree[0][1][1] if len(tree) == 1 and tree[0][0] is sre.BRANCH else [tree]
    out = []
    for b in branches:
        seq, found, i = _flat(b), [], 0
        while i < len(seq):
            if seq[i][0] is sre.LITERAL and _plain(seq[i][1]):
                j = i
                while j < len(seq) and seq[j][0] is sre.LITERAL and _plain(seq[j][1]):
                    j += 1
                if i > 0 and _edge(seq[i - 1]) and j < len(seq) and _edge(seq[j]):
                    found.append("".join(chr(c).lower() for _, c in seq[i:j]))
                i = j
            else:
                i += 1
        out.append(found)
    return out


def url_tokens(url):
    return F.array_distinct(F.filter(F.split(F.lower(url), _TOKEN), lambda t: t != ""))


RULE = "rule_id int, pattern string, action string"


def rule_index(rules: DataFrame) -> DataFrame:
    """(rule_id, pattern, action, alternatives): what required_tokens finds for each rule of a table of them."""

    def run(frames):
        for f in frames:
            for p in f["pattern"]:
                re.compile(p)
            yield f.assign(alternatives=[required_tokens(p) for p in f["pattern"]])

    r = rules.select(F.col("rule_id").cast("int").alias("rule_id"), "pattern", "action").where("rule_id is not null and pattern is not null").distinct()
    return r.mapInPandas(run, f"{RULE}, alternatives array<array<string>>")


def match(pages: DataFrame, rules: DataFrame | list[tuple[int, str, str]]) -> DataFrame:
    """(page_id, rule_id, action) for every page and every rule that matches its URL, case aside."""
    if isinstance(rules, list):
        rules = pages.sparkSession.createDataFrame(rules, RULE)
    parsed = written(rule_index(rules), "url-rules")
    size = F.octet_length("pattern") + 64
    certain = F.forall("alternatives", lambda a: F.size(a) > 0)
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").where("url is not null")
    tokens = p.select("page_id", "url", F.explode(url_tokens("url")).alias("token"))
    alt = parsed.where(certain).select("rule_id", "pattern", "action", F.posexplode("alternatives").alias("alt", "words"))
    alt = alt.select("rule_id", "pattern", "action", "alt", F.explode("words").alias("token"))
    wanted = alt.select("token").distinct()
    seen = tokens.select("token").join(small(wanted, F.octet_length("token") + 32), "token").groupBy("token").count()
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token"))["token"]
    index = alt.join(small(written(seen, "url-tokens"), F.octet_length("token") + 40), "token", "left").groupBy("rule_id", "pattern", "action", "alt").agg(rarest.alias("token"))
    index = written(index.select("token", *(c.split()[0] for c in RULE.split(", "))).distinct(), "url-index")
    fetched = tokens.join(small(index, size + F.octet_length("token")), "token").drop("token")
    every = p.crossJoin(small(parsed.where(~certain).drop("alternatives"), size))
    return fetched.unionByName(every).where(F.expr("url rlike concat('(?i)', pattern)")).select("page_id", "rule_id", "action").distinct()


_BLOCKED = (
    "casino poker betting jackpot slots lottery xxx porn adult escort nude webcam viagra pharmacy cialis pills warez torrent crack keygen "
    "serial nulled proxy vpn-free spyware malware phishing loan payday forex crypto-giveaway airdrop replica counterfeit essay-mill "
    "clickbait doorway linkfarm spam spamblog autogen scraper adserver doubleclick popunder banner-ads tracker pixel beacon affiliate"
).split()
_LANGUAGES = "ar bg cs da de el en es et fi fr he hi hu id it ja ko lt lv nl no pl pt ro ru sk sl sv th tr uk vi zh".split()


def production_rules() -> list[tuple[int, str, str]]:
    """(rule_id, pattern, action): blocked words in host or path, sections by language, tracking and paging."""
    patterns: list[tuple[str, str]] = []
    for w in _BLOCKED:
        patterns.append((rf"[./_-]{w}[./_?#-]", "block"))
        patterns.append((rf"//{w}\.", "block"))
    for lang in _LANGUAGES:
        patterns.append((rf"/{lang}/[0-9]+(?:\.html|/)?$", f"section-{lang}"))
        patterns.append((rf"//{lang}\.[a-z0-9.-]+/", f"host-{lang}"))
    patterns += [
        (r"^https?://(?:m|mobile|amp|www)\.[a-z0-9.-]+/", "mirror"),
        (r"//blog\.|/blog/", "blog"),
        (r"\?page=[0-9]+&", "paged"),
        (r"[?&]utm_source=[a-z]+", "tracking"),
        (r"[?&](?:gclid|fbclid|msclkid)=", "tracking"),
        (r"[?&]ref=x\b", "tracking"),
        (r"#top$", "fragment"),
        (r"\.html#|\.php\?", "dynamic"),
        (r"^http://", "insecure"),
        (r"/(?:000|111|222|333|444|555|666|777|888|999)[0-9]*\b", "repeated-digits"),
    ]
    return [(i, p, a) for i, (p, a) in enumerate(patterns)]


def match_production(pages: DataFrame) -> DataFrame:
    return match(pages, production_rules())


def oracle(rules: list[tuple[int, str, str]] | None = None) -> str:
    """The same result by running every rule on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {q('(?i)' + p)}, {q(a)})" for i, p, a in rules or production_rules())
    return f"""SELECT DISTINCT CAST(page_id AS BIGINT) AS page_id, CAST(rule_id AS INTEGER) AS rule_id, action
FROM pages, (VALUES {values}) AS r(rule_id, pattern, action) WHERE regexp_matches(url, pattern)"""
