"""Text functions as Catalyst expressions: every one takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill.functions import vocabulary as V

WORD = r"[\p{L}\p{N}_]"
#: Kind, pattern and token, in the order in which they are replaced.
_REDACTIONS = [
    ("url_query", V.URL_QUERY, "[URL]"), ("url", V.URL, "[URL]"), ("email", V.EMAIL, "[EMAIL]"), ("api_key", V.API_KEY, "[SECRET]"), ("ip", V.IPV4, "[IP]"),
    ("card", V.CARD, "[CARD]"), ("keyed_secret", V.KEYED_SECRET, "$1=[SECRET]"), ("account", V.ACCOUNT, "$1[ACCOUNT]"), ("phone", V.PHONE, "[PHONE]"),
]


def squeezed(text: Column) -> Column:
    """White space runs turned to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def redacted(text: Column, kinds: list[str] | None = None) -> Column:
    """Personal data (of some ``kinds``, else all) replaced by tokens, in the order of the patterns; null gives ''.

    Each step names its input once, so the expression grows with the number of patterns only.
    """
    out = F.coalesce(text, F.lit(""))
    for kind, pattern, token in _REDACTIONS:
        if kinds is None or kind in kinds:
            out = F.regexp_replace(out, pattern, token)
    return out


def redaction_counts(text: Column, kinds: list[str] | None = None) -> Column:
    """Map of substitutions by kind, each counted on the text that its pattern sees, which is worked out once."""
    steps = [x for x in _REDACTIONS if kinds is None or x[0] in kinds]

    def step(seen: Column, k: int, counts: list[Column]) -> Column:
        if k == len(steps):
            return F.create_map(*(x for (kind, _, _), n in zip(steps, counts, strict=True) for x in (F.lit(kind), n)))
        _, pattern, token = steps[k]
        both = F.struct(F.regexp_replace(seen, pattern, token).alias("text"), F.regexp_count(seen, F.lit(pattern)).alias("n"))
        return F.transform(F.array(both), lambda x: step(x["text"], k + 1, [*counts, x["n"]]))[0]

    return F.map_filter(step(F.coalesce(text, F.lit("")), 0, []), lambda _, n: n > 0)


PII_KINDS = {"email": V.EMAIL, "phone": V.PHONE, "ip": V.IPV4, "api_key": V.API_KEY, "url": V.URL, "url_with_query": V.URL_QUERY, "card": V.CARD, "account": V.ACCOUNT}


def pii_counts(text: Column) -> dict[str, Column]:
    """Hits of each kind on the unchanged text."""
    return {k: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for k, p in PII_KINDS.items()}


def placeholders(text: Column) -> Column:
    """Unfilled template tokens, without the tokens of ``redacted``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.PLACEHOLDER), F.lit(0))
    return F.filter(found, lambda t: ~F.lower(F.trim(t)).isin(V.OWN_TOKENS))


def without_placeholders(text: Column) -> Column:
    own = "|".join(t.replace("[", r"\[").replace("]", r"\]") for t in V.OWN_TOKENS)
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)(?!(?:{own})){V.PLACEHOLDER[4:]}", " "), r"\s{2,}", " "))


def dedup_normalised(text: Column) -> Column:
    """Lower case without identifiers and punctuation; only for duplicate statistics."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, rf"(?<!{WORD})[a-z]*\d[\p{{L}}\p{{N}}_\-]*(?!{WORD})", " ")
    return squeezed(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "))


def lexical_normalised(text: Column, technical: bool = True) -> Column:
    """Lower case that keeps . / # - and, if ``technical``, sets technical tokens apart."""
    out = F.coalesce(text, F.lit(""))
    if technical:
        out = F.regexp_replace(out, V.TECHNICAL, " $0 ")
    return squeezed(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}_\s./#\-]", " "))


def lexical_tokens(text: Column, technical: bool = True) -> Column:
    return F.filter(F.split(lexical_normalised(text, technical), " "), lambda t: t != "")


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own; '' has none."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, many).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def note_class(text: Column) -> Column:
    """action, info_request or unclear; an action wins."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unclear").when(text.rlike(V.ACTION), "action").when(text.rlike(V.ASKS), "info_request").otherwise("unclear")


def _labels(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items())))


def injection_labels(text: Column) -> Column:
    return _labels(F.coalesce(text, F.lit("")), V.INJECTION)


def overclaim_labels(text: Column) -> Column:
    return _labels(F.coalesce(text, F.lit("")), V.OVERCLAIM)


def samples(text: Column, patterns: dict[str, str], most: int = 5, length: int = 120) -> Column:
    """First match of each pattern that hits, shortened."""
    found = F.array_compact(F.array(*(F.when(text.rlike(p), F.substring(F.trim(F.regexp_extract(text, p, 0)), 1, length)) for p in patterns.values())))
    return F.slice(found, 1, most)


def neutralised(text: Column) -> Column:
    """Delimiters of a data block, broken so that text cannot close the block it stands in."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<(/?)(evidence|instruction|system|prompt|context)\s*>", "<$1 $2>")
    out = F.regexp_replace(out, r"(?i)\[(/?)(INST|SYS|EVIDENCE)\]", "[$1 $2]")
    return F.regexp_replace(out, r"(?i)<\|([a-z_]{2,20})\|>", "< |$1| >")


def hashed_id(value: Column, salt: str = "casemill") -> Column:
    """16 digits of a salted digest; blank gives null."""
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed != "", F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), trimmed), 256), 1, 16))


def null_tokens_out(value: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).isin(V.NULL_TOKENS), value)


def as_boolean(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(V.TRUE_TOKENS), True).when(low.isin(V.FALSE_TOKENS), False)


def as_text(value: Column) -> Column:
    """Null and its spellings become ''."""
    return F.when(F.coalesce(F.lower(F.trim(value)).isin("nan", "nat", "none"), F.lit(True)), "").otherwise(F.trim(value))


def hours_between(start: Column, end: Column) -> Column:
    """Hours, null if negative."""
    hours = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9
    return F.when(hours >= 0, hours)


def retrieval_document(issue: Column, area: Column, kind: Column) -> Column:
    """The problem side of a case, facets first; outcomes never enter it."""
    facet = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", facet("Product Area", area), facet("Issue Type", kind), F.concat(F.lit("Issue: "), issue))


def json_object(text: Column, schema: str) -> Column:
    """The first JSON object found in a fence, in the whole text or between outer braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(*(F.when(F.get_json_object(c, "$").startswith("{"), F.from_json(c, schema)) for c in (fenced, F.trim(text), outer)))
