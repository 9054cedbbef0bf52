"""Column functions on text: tokens, identities, safe names, redaction. All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
#: Fixed value: token pattern of the lexical index (path, identifier, CJK run).
TOKEN = r"/(?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+|[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*|" + CJK + "+"
WHITE = " \t\n\r\x0b\x0c"
UNIT = "\x1f"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def token_estimate(c: Column) -> Column:
    """CJK characters plus runs of ASCII word characters outside them."""
    c = F.coalesce(c, F.lit(""))
    return F.size(F.regexp_extract_all(c, F.lit(CJK), 0)) + F.size(F.regexp_extract_all(F.regexp_replace(c, CJK, " "), F.lit("[A-Za-z0-9_]+"), 0))


def clean(c: Column) -> Column:
    """Right-strips every line, then strips the whole."""
    return strip(F.regexp_replace(c, r"(?m)[ \t\r\x0b\x0c]+$", ""))


def lexical_tokens(c: Column) -> Column:
    """Lower-cased tokens in order; a CJK run gives itself and then its bigrams."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)
    bigrams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    each = lambda t: F.when(t.rlike("^" + CJK + "{2,}$"), F.concat(F.array(t), bigrams(t))).otherwise(F.array(t))
    return F.when(c.rlike(CJK), F.flatten(F.transform(parts, each))).otherwise(parts)


def match_key(c: Column) -> Column:
    """Lower case without white space; the exact form with compatibility folding is functions.exact.match_key."""
    return F.lower(F.regexp_replace(c, r"\s", ""))


def basename(c: Column) -> Column:
    return F.substring_index(F.translate(c, "\\", "/"), "/", -1)


def safe_filename(c: Column) -> Column:
    """A display name: no path, no reserved characters, no traversal, at most 180 characters."""
    v = F.regexp_replace(basename(F.coalesce(c, F.lit(""))), r'[<>:"|?*]', "_")
    v = F.btrim(F.regexp_replace(v, r"\.{2,}", "_"), F.lit(" ."))
    v = F.btrim(F.regexp_replace(v, r"\s+", " "))
    return F.when(F.translate(v, "_", "") == "", F.lit("unnamed")).otherwise(F.substr(v, F.lit(1), F.lit(180)))


def safe_key(c: Column) -> Column:
    v = F.substr(strip(F.regexp_replace(c, r"[\\/\x00]", "_")), F.lit(1), F.lit(255))
    return F.when(v == "", F.lit("unnamed")).otherwise(v)


#: What error messages must not show.
SECRETS = (r"mongodb(?:\+srv)?://[^\s]+", r"Bearer\s+\S+", r"(?:api[_-]?key|password|token)\s*[=:]\s*\S+")


def safe_error(c: Column) -> Column:
    for pattern in SECRETS:
        c = F.regexp_replace(c, "(?i)" + pattern, "[redacted]")
    return F.substr(c, F.lit(1), F.lit(300))


def redacted_metadata(c: Column) -> Column:
    """A map<string,string> whose secret-looking keys lose their value and whose absolute paths become names."""
    value = lambda k, v: F.when(k.rlike("(?i)api[_-]?key|authorization|password|secret|token"), F.lit("[redacted]")).when(v.rlike(r"^(?:[A-Za-z]:[\\/]|[\\/]{1,2})"), safe_filename(v)).otherwise(v)
    return F.transform_values(c, value)


def safe_details(c: Column) -> Column:
    """A map<string,string> without keys that may hold content or secrets."""
    # fixed values: what keys must not name
    denied = "content|query|prompt|answer|secret|password|credential|api_key|authorization|url|path|exception"
    return F.map_filter(c, lambda k, v: ~k.rlike("(?i)" + denied))


def digest(*parts: Column, length: int = 64) -> Column:
    """SHA-256 over the parts joined by the unit separator; a null part counts as empty."""
    return F.substr(F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(1), F.lit(length))


def evidence_key(document: Column, version: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    return digest(document, version, subject, predicate, obj)


def edge_fingerprint(*fields: Column) -> Column:
    """24 hex digits; white space of each field is collapsed and the field cut to 160 characters."""
    return digest(*[F.substr(F.btrim(F.regexp_replace(F.coalesce(f.cast("string"), F.lit("")), r"\s+", " ")), F.lit(1), F.lit(160)) for f in fields], length=24)


def child_candidate_id(chunk: Column, *identity: Column) -> Column:
    return F.coalesce(F.when(chunk != "", chunk), F.concat(F.lit("legacy-child:"), digest(*identity)))


def graph_candidate_id(keys: Column, fallback: Column) -> Column:
    """One edge: graph:key; a path: digest of its keys; none: digest of the content."""
    joined = F.sha2(F.array_join(keys, UNIT), 256)
    return F.when(F.size(keys) == 1, F.concat(F.lit("graph:"), keys[0])).when(F.size(keys) > 1, F.concat(F.lit("graph-path:"), joined)).otherwise(F.concat(F.lit("graph-legacy:"), F.sha2(fallback, 256)))


def edges_text(edges: Column) -> Column:
    """One line per edge of an array of (subject, predicate, object, direction)."""
    return F.array_join(F.transform(edges, lambda e: F.concat(e["subject"], F.lit(" --"), e["predicate"], F.lit("--> "), e["object"], F.lit(" [direction: "), e["direction"], F.lit("]"))), "\n")


def report_category(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin("unanswerable", "abstention"), "abstention").when(v.startswith("distractor"), "distractor").when(v.startswith("constraint"), "constraint").otherwise(v)


def upload_payload_hash(c: Column) -> Column:
    """SHA-256 of the text with LF line ends and one final LF removed."""
    return F.sha2(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), 256)


def alias_match(a: Column, b: Column) -> Column:
    """Equal or one inside the other, without spaces, hyphens and underscores, from two characters on."""
    x, y = F.lower(F.regexp_replace(a, r"[\s_-]", "")), F.lower(F.regexp_replace(b, r"[\s_-]", ""))
    return (F.length(x) >= 2) & (F.length(y) >= 2) & (x.contains(y) | y.contains(x))


def summary(user: Column, answer: Column) -> Column:
    whole = F.concat(F.lit("用户："), user, F.lit("\n助手："), answer)
    return F.when(F.length(whole) > 200, F.concat(F.substr(whole, F.lit(1), F.lit(200)), F.lit("..."))).otherwise(whole)


def clamped(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def failure_category(status: Column, kind: Column) -> Column:
    """Ordered rules over an HTTP-like status and an error type; messages are never looked at."""
    return (
        F.when(kind.rlike("(?i)validation"), "validation").when(status == 429, "provider_rate_limit").when(status.isin(401, 403), "provider_auth")
        .when(status >= 400, "provider_http").when(kind.rlike("(?i)timeout"), "provider_timeout").when(kind.rlike("(?i)network|connection"), "provider_connection")
        .when(kind.rlike("JSONDecode"), "provider_invalid_response").otherwise("unknown")
    )


def read_only_statement(c: Column) -> Column:
    """Whether a graph query only reads: it begins with MATCH, OPTIONAL MATCH or WITH, is one statement, and names no write verb."""
    v = F.regexp_replace(strip(c), r";\s*$", "")
    return v.rlike(r"(?is)^(?:optional\s+match|match|with)\b") & ~v.contains(";") & ~v.rlike(r"(?i)\b(?:create|merge|delete|detach|set|remove|drop|call|load|foreach)\b")


def intent(c: Column) -> Column:
    v = F.lower(c)
    out = F.lit("factoid")
    for name in ("comparison", "summary", "multi_hop"):
        out = F.when(v.contains(name), name).otherwise(out)
    return out
