"""Operator 9: secret scans that link the parts of a credential.

One regular expression finds access identifiers, secrets and endpoints; those that it passes
over inside a longer part (a token in a URL) are searched for by themselves; an interval join links
complementary parts (a secret with an identifier or an endpoint) that lie within a scope of
text.  Strong parts (a provider's key format, a named assignment of a secret) are reported by
themselves; weak ones (user names, mail addresses, hosts, bare key-like runs) only when
complementary parts co-occur in scope.  All of it is built from Spark SQL expressions.

Positions are zero-based code points.  Values are given as MD5, never in clear.

Defined results: a null or empty text has no parts; a null doc_id keeps its parts, under null;
rows that repeat a (doc_id, text) count once; every complementary part in scope is counted, so
ties need no order; parts may overlap, and are masked as one; texts of any length are searched
whole; an empty table gives no rows.  Extra columns are not read, and redact() leaves them alone
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import small, written

SCOPE = 300
MASK = "[SECRET]"

# Secrets, user names and endpoints have no greatest length: the rest of a longer one would be neither linked nor masked.
KEY_ID = r"AKIA[A-Z0-9]{16}"
ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,}[\"']?"
RUN = r"[A-Za-z0-9+/]{32,}+"
USER = r"(?i:username|user|login|client_id|account)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9@._-]{3,}[\"']?"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s+[A-Za-z-]+: [^\r\n]*){0,20}(?:[A-Za-z0-9+/=\s\\]*-----END [A-Z ]*PRIVATE KEY-----|[\s\\n]+[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\s\\]*)"
#: Secrets known by their provider's prefix.
PREFIXED = r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,5}"
URL = r"[a-z][a-z0-9+]{1,15}://[^ \t\r\n\"'<>]{3,}+"
HOST = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?"
ANY = "|".join((KEY_ID, PEM, PREFIXED, ASSIGNED, USER, MAIL, URL, HOST, RUN))
#: user:password before an endpoint's host.
LOGIN = r"[^ \t\r\n\"'<>/?#@:]*:[^ \t\r\n\"'<>/?#]+"
#: What is searched for by itself too: a match of ANY may hold it and be of another kind, or weaker.
INNER = ((KEY_ID, "access strong"), (PEM, "secret strong"), (PREFIXED, "secret strong"), (ASSIGNED, "secret strong"), (f"(?<=://){LOGIN}(?=@)", "secret strong"), (USER, "access weak"))
#: Without a match of one of these a document has nothing to report: weak identifiers and endpoints need a secret.  The first is
#: tried only at signs that one of its branches begins with; names are looked for behind their separator.
NEEDED = (
    "(?=[=:Agxrs-])(?:" + "|".join((
        r"[=:](?<=(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)[\"']?[ \t]{0,3}[=:])[ \t]{0,3}[\"']?[A-Za-z0-9+/_.~-]{8}",
        f"://{LOGIN}@", KEY_ID, PEM.partition("[A-Z ]*")[0], r"g(?:h[pousr]_[A-Za-z0-9]{36}|ithub_pat_|lpat-)", "xox[abeoprs]-", "[rs]k[-_]", "AIza",
    )) + ")",
    r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}",
)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start_pos, end_pos, kind, strength, value_md5) of every part of documents that may be reported."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").rlike(NEEDED[0]) | F.col("text").rlike(NEEDED[1])).distinct()
    search = lambda i, p: F.struct(F.lit(i).alias("search"), F.expr(f"regexp_extract_all(text, {_lit(p)}, 0)").alias("m"), F.split("text", p).alias("gap"))
    d = d.select("doc_id", F.md5("text").alias("text_key"), F.explode(F.array(*(search(i, p) for i, p in enumerate((ANY, *(p for p, _ in INNER)))))).alias("s"))
    x = d.select("doc_id", "text_key", "s.search", F.posexplode(F.arrays_zip("s.m", "s.gap"))).where("col.m is not null")
    run = W.Window.partitionBy("doc_id", "text_key", "search").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    x = x.select("doc_id", "text_key", "search", "col.m", F.sum(F.length("col.gap") + F.length("col.m")).over(run).cast("int").alias("end_pos"))
    whole = lambda p: F.col("m").rlike(f"^(?:{p})$")
    label = (
        F.when(whole(KEY_ID), "access strong")
        .when(whole(PEM) | whole(PREFIXED) | whole(ASSIGNED), "secret strong")
        .when(whole(USER) | whole(MAIL), "access weak")
        .when(whole(URL) | whole(HOST), "endpoint weak")
        .when(F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Za-z]"), "secret weak")
    )
    inner = F.element_at(F.array(*(F.lit(k) for _, k in INNER)), F.col("search"))
    x = x.withColumn("label", F.when(F.col("search") > 0, inner).otherwise(label)).where("label is not null")
    kind, strength = (F.split_part("label", F.lit(" "), F.lit(i)).alias(c) for i, c in ((1, "kind"), (2, "strength")))
    x = x.select("doc_id", "text_key", (F.col("end_pos") - F.length("m")).alias("start_pos"), "end_pos", kind, strength, F.md5("m").alias("value_md5"), "search")
    # What lies in a match of ANY that is of its kind and no weaker is no part of its own.
    upto = W.Window.partitionBy("doc_id", "text_key", "kind").orderBy("start_pos").rangeBetween(W.Window.unboundedPreceding, 0)
    covered = F.max(F.when(F.col("search") == 0, F.col("end_pos"))).over(upto)
    strongly = F.max(F.when((F.col("search") == 0) & (F.col("strength") == "strong"), F.col("end_pos"))).over(upto)
    x = x.withColumn("covered", F.coalesce(F.when(F.col("strength") == "strong", strongly).otherwise(covered), F.lit(0)))
    return x.where("search = 0 or covered < end_pos").drop("search", "covered").distinct()


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Reported parts, each with the number of complementary parts of every kind in its scope."""
    p = written(parts(docs), "parts")
    near = p.withColumn("bin", F.explode(F.expr(f"sequence(floor((start_pos - {scope}) / {scope}), floor((end_pos + {scope}) / {scope}))")))
    other = p.select("doc_id", "text_key", F.col("start_pos").alias("s2"), F.col("end_pos").alias("e2"), F.col("kind").alias("k2"), F.explode(F.expr(f"sequence(floor(start_pos / {scope}), floor(end_pos / {scope}))")).alias("bin"))
    a, b = near.alias("a"), other.alias("b")
    hit = a.join(
        b,
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.bin") == F.col("b.bin"))
        & ((F.col("kind") == "secret") != (F.col("k2") == "secret")) & (F.col("s2") <= F.col("end_pos") + scope) & (F.col("e2") >= F.col("start_pos") - scope),
        "left",
    )
    count = lambda k: F.count_distinct(F.when(F.col("k2") == k, F.col("s2"))).cast("int").alias(f"n_{k}")
    keys = [F.col(f"a.{c}").alias(c) for c in p.columns]
    return hit.groupBy(*keys).agg(count("access"), count("secret"), count("endpoint")).where("strength = 'strong' or n_access + n_secret + n_endpoint > 0")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    return report(docs, scope).drop("text_key").distinct()


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with every reported part replaced by a mask, and n_chars (where there is one) recounted; no document is dropped."""
    spans = report(docs, scope).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos"))).alias("spans"))
    spans = written(spans, "secret-spans")
    # The expressions are not run again: a row is known by its id and its text's MD5.
    d, s = docs.alias("d"), small(spans, 16 * F.size("spans") + 100).alias("s")
    x = d.join(s, F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("s.id")) & (F.md5("d.text") == F.col("s.key")), "left")
    # One column holds the row as it was, so no name of the table's can clash.
    x = x.select(F.struct(F.struct(*(F.col(f"d.`{c}`") for c in docs.columns)).alias("row"), F.col("s.spans").alias("spans")).alias("x"))
    masked = F.expr(
        f"""aggregate(x.spans, struct(0 as at, '' as out),
            (a, s) -> struct(greatest(a.at, s.end_pos) as at, if(s.start_pos < a.at, a.out, concat(a.out, substring(x.row.text, a.at + 1, s.start_pos - a.at), '{MASK}')) as out),
            a -> concat(a.out, substring(x.row.text, a.at + 1)))"""
    )
    x = x.select("x", F.when(F.col("x.spans").isNotNull(), masked).alias("masked"))
    types = dict(docs.dtypes)
    new = {"text": F.coalesce("masked", "x.row.text"), "n_chars": F.when(F.col("masked").isNull(), F.col("x.row.n_chars") if "n_chars" in types else F.lit(None)).otherwise(F.length("masked").cast(types.get("n_chars", "int")))}
    return x.select(*((new[c] if c in new else F.col(f"x.row.`{c}`")).alias(c) for c in docs.columns))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The SQL's own expressions, as first written: one alternation, lengths bounded.
_ORACLE_KEY_ID = r"AKIA[A-Z0-9]{16}"
_ORACLE_ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api_key|apikey|access_key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,256}[\"']?"
_ORACLE_RUN = r"[A-Za-z0-9+/]{32,256}"
_ORACLE_USER = r"(?i:username|user|login|client_id|account)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9@._-]{3,128}[\"']?"
_ORACLE_MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,5}"
_ORACLE_URL = r"[a-z][a-z0-9+]{1,15}://[^ \t\r\n\"'<>]{3,512}"
_ORACLE_HOST = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?"
_ORACLE_ANY = "|".join((_ORACLE_KEY_ID, _ORACLE_ASSIGNED, _ORACLE_USER, _ORACLE_MAIL, _ORACLE_URL, _ORACLE_HOST, _ORACLE_RUN))
_ORACLE_NEEDED = "|".join((_ORACLE_KEY_ID, _ORACLE_ASSIGNED, _ORACLE_RUN))

ORACLE = f"""
WITH d AS (SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents WHERE regexp_matches(text, {_sql(_ORACLE_NEEDED)})),
x AS (SELECT doc_id, md5(text) AS text_key, regexp_extract_all(text, {_sql(_ORACLE_ANY)}) AS m, regexp_split_to_array(text, {_sql(_ORACLE_ANY)}) AS gap FROM d),
y AS (SELECT doc_id, text_key, m, gap, unnest(range(1, len(m) + 1)) AS i FROM x),
z AS (SELECT doc_id, text_key, m[i] AS m, i, sum(length(gap[i]) + length(m[i])) OVER (PARTITION BY doc_id, text_key ORDER BY i) AS end_pos FROM y),
p AS (SELECT doc_id, text_key, CAST(end_pos - length(m) AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos, md5(m) AS value_md5,
        CASE WHEN regexp_full_match(m, {_sql(_ORACLE_KEY_ID)}) THEN 'access strong' WHEN regexp_full_match(m, {_sql(_ORACLE_ASSIGNED)}) THEN 'secret strong'
             WHEN regexp_full_match(m, {_sql(_ORACLE_USER)}) OR regexp_full_match(m, {_sql(_ORACLE_MAIL)}) THEN 'access weak'
             WHEN regexp_full_match(m, {_sql(_ORACLE_URL)}) OR regexp_full_match(m, {_sql(_ORACLE_HOST)}) THEN 'endpoint weak'
             WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') THEN 'secret weak' END AS label FROM z),
q AS (SELECT *, split_part(label, ' ', 1) AS kind, split_part(label, ' ', 2) AS strength FROM p WHERE label IS NOT NULL),
r AS (SELECT a.doc_id, a.text_key, a.start_pos, a.end_pos, a.kind, a.strength, a.value_md5,
        CAST(count(DISTINCT CASE WHEN b.kind = 'access' THEN b.start_pos END) AS INTEGER) AS n_access,
        CAST(count(DISTINCT CASE WHEN b.kind = 'secret' THEN b.start_pos END) AS INTEGER) AS n_secret,
        CAST(count(DISTINCT CASE WHEN b.kind = 'endpoint' THEN b.start_pos END) AS INTEGER) AS n_endpoint
      FROM q a LEFT JOIN q b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text_key = b.text_key AND (a.kind = 'secret') <> (b.kind = 'secret')
        AND b.start_pos <= a.end_pos + {SCOPE} AND b.end_pos >= a.start_pos - {SCOPE}
      GROUP BY ALL)
SELECT DISTINCT doc_id, start_pos, end_pos, kind, strength, value_md5, n_access, n_secret, n_endpoint FROM r
WHERE strength = 'strong' OR n_access + n_secret + n_endpoint > 0
"""
