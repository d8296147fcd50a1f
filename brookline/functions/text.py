"""Text functions: cleaning, gates, symbol matching, link identity, query atoms."""

from __future__ import annotations

import html
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of what cleaning replaces.
LINK, MENTION, SPACE = r"(?iU)https?://\S+|www\.\S+", r"(?U)@\w+", r"(?U)\s+"
SPAM_WORDS = ["rt", "via"]
# A character reference as HTML has it, the one that html.unescape looks for.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
UNSAFE_IN_QUERY = r"[^\p{L}\p{N}_ .,'&+:/()-]"
LEAST_BYTES = 3


def _decode(references: pd.Series) -> pd.Series:
    return references.map(lambda r: None if r is None else [html.unescape(x) for x in r])


def _canonical(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url)


_decoded = F.pandas_udf(_decode, T.ArrayType(T.StringType()))
canonical = F.pandas_udf(_canonical, T.StringType())


def canonical_url(raw: str | None) -> str | None:
    """One form of a web address: lower-case host, no default port, no fragment, sorted query; None if it is no such address."""
    try:
        parts = urlsplit(raw or "")
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not parts.hostname:
        return None
    host = parts.hostname.lower() + (f":{port}" if port and port != {"http": 80, "https": 443}[scheme] else "")
    if parts.username is not None:
        host = parts.netloc.rsplit("@", 1)[0] + "@" + host
    return urlunsplit((scheme, host, parts.path or "/", urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True))), ""))


def unescape(text: Column) -> Column:
    """Character references decoded. Only they go to Python, so what a task holds there does not follow the length of its texts."""
    has = text.contains("&")
    decoded = _decoded(F.when(has, F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))))
    between = F.split(text, REFERENCE, -1)
    whole = F.zip_with(between, decoded, lambda plain, one: F.concat(plain, F.coalesce(one, F.lit(""))))
    return F.when(has, F.array_join(whole, "")).otherwise(text)


def clean(text: Column) -> Column:
    """Entities decoded, links and mentions replaced, white space squeezed."""
    plain = F.regexp_replace(unescape(text), LINK, "http")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, MENTION, "@user"), SPACE, " "))


def long_enough(text: Column) -> Column:
    return F.octet_length(text) >= LEAST_BYTES


def without_nul(text: Column) -> Column:
    return F.regexp_replace(text, "\\x00", "")


def real_words(text: Column) -> Column:
    """Number of words that are no tags, mentions, links or forwarding marks and have a letter or digit."""
    words = F.split(F.lower(F.trim(text)), SPACE)
    real = lambda w: ~w.startswith("$") & ~w.startswith("@") & ~w.contains("http") & ~w.isin(SPAM_WORDS) & w.rlike(r"[\p{L}\p{N}]")
    return F.size(F.filter(words, real))


def is_outlier(text: Column) -> Column:
    return real_words(text) < 3


@dataclass
class Rule:
    """How posts are matched to a symbol."""

    symbol: str
    keywords: list[str] = field(default_factory=list)
    block_phrases: list[str] = field(default_factory=list)
    require_cashtag: bool = False
    require_uppercase: bool = False


def bounded(text: Column, needles: list[str], any_case: bool) -> Column:
    """One of the needles between characters that are no ASCII letters or digits: one scan of the text for all of them."""
    if not needles:
        return F.lit(False)
    quoted = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in needles)
    pattern = f"(?:^|[^A-Za-z0-9])(?:{quoted})(?:$|[^A-Za-z0-9])"
    if not any_case:
        return text.rlike(pattern)
    # where all letters are ASCII, folding the case of others changes nothing and costs much
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text.rlike(f"(?i){pattern}")).otherwise(text.rlike(f"(?iu){pattern}"))


def matches(text: Column, rule: Rule) -> Column:
    """A block phrase rules out; then the cashtag or a keyword; then, unless a cashtag is required, the symbol itself."""
    own = [] if rule.require_cashtag else [rule.symbol]
    hit = bounded(text, ["$" + rule.symbol, *rule.keywords, *([] if rule.require_uppercase else own)], True)
    if rule.require_uppercase and own:
        hit = hit | bounded(text, own, False)
    if not rule.block_phrases:
        return hit
    low = F.lower(text)
    blocked = F.lit(False)
    for phrase in rule.block_phrases:
        blocked = blocked | low.contains(phrase.lower())
    return hit & ~blocked


def matched_symbols(text: Column, rules: list[Rule]) -> Column:
    """Array of the symbols that match: one expression over a text, no join with the rules, which are configuration."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(matches(text, r), r.symbol) for r in rules]))


def query_atom(value: Column) -> Column:
    """A quoted query term of safe characters; NULL if nothing is left."""
    safe = F.trim(F.regexp_replace(F.regexp_replace(value, UNSAFE_IN_QUERY, " "), SPACE, " "))
    return F.when(safe != "", F.concat(F.lit('"'), safe, F.lit('"')))


def event_query(terms: Column, countries: Column, themes: Column) -> Column:
    """OR within a group, AND between terms, countries and themes; NULL if all are empty or a value is."""

    def group(values: Column, mark: str) -> Column:
        atoms = F.transform(values, lambda v: F.concat(F.lit(mark), query_atom(v)))
        return F.when(F.size(values) > 0, F.concat(F.lit("("), F.array_join(atoms, " OR "), F.lit(")")))

    groups = [group(terms, ""), group(countries, ""), group(themes, "theme:")]
    valid = F.lit(True)
    for values in (terms, countries, themes):
        valid = valid & ~F.exists(values, lambda v: query_atom(v).isNull())
    joined = F.array_join(F.array_compact(F.array(*groups)), " AND ")
    return F.when(valid & (joined != ""), joined)
