"""URL filter: path rules first, then a weighted vocabulary searched with one Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One of these in a url rejects it.
STRICT = ("casino", "escort", "hentai", "malware", "nsfw", "phishing", "porn", "spam", "viagra", "warez", "xxx")
#: Several different ones of these reject it.
SOFT = ("adult", "ads", "bet", "bets", "bonus", "cheap", "click", "dating", "deal", "farm", "free", "gambling", "jackpot", "loan", "loans", "lottery", "pills", "poker", "promo", "sex", "slots", "track", "win")
SOFT_LIMIT = 2
#: (verdict, rule): host and path; a rule holds for its host and all subdomains.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = frozenset(LOWER + "0123456789")


def vocabulary(terms: DataFrame, soft_limit: int = SOFT_LIMIT, most: int = 1_000_000) -> tuple[list[str], dict[str, int]]:
    """(strict terms, weights of soft terms) of a table (term, weight) of whole numbers: a weight of soft_limit or more is strict, of equal terms the largest weight counts. The table is
    sent to all workers, so it has at most `most` terms; more are an error, and so is a weight that is no whole number."""
    whole = F.when(F.col("weight") != F.floor("weight"), F.raise_error(F.concat(F.lit("no whole weight: "), F.col("term"))).cast("long")).otherwise(F.floor("weight"))
    rows = terms.select(F.translate("term", UPPER, LOWER).alias("term"), whole.alias("weight")).where("length(term) > 0 and weight > 0").groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return [r["term"] for r in rows if r["weight"] >= soft_limit], {r["term"]: int(r["weight"]) for r in rows if r["weight"] < soft_limit}


def automaton(strict: Sequence[str], soft: Sequence[str] | Mapping[str, int], soft_limit: int) -> ahocorasick.Automaton:
    """Terms with their weights: a soft one has its own, or 1 where none are given; a strict one weighs as much as the limit."""
    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term, (term, soft[term] if isinstance(soft, Mapping) else 1))
    for term in strict:
        a.add_word(term, (term, soft_limit))
    if len(a):
        a.make_automaton()
    return a


def found_terms(a: ahocorasick.Automaton, url: str) -> dict[str, int]:
    """The weight of each distinct term that stands alone in the url, between characters other than a-z and 0-9."""
    out: dict[str, int] = {}
    for end, (term, weight) in a.iter(url) if len(a) else ():
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in WORD) and (end + 1 == len(url) or url[end + 1] not in WORD):
            out[term] = weight
    return out


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] | Mapping[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, weight, terms) for every row of pages, one for one.

    The longest rule that fits decides, of equally long ones the last in the order of their texts; without one, a url is blocked if the weights of its distinct terms reach
    soft_limit. A null url, or one without ://, has an empty host and path, and no rule; a null url has no terms either.
    A null page_id is passed on; repeated rows get a row each. Other columns are not read.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft, soft_limit)
        low = str.maketrans(UPPER, LOWER)
        for b in batches:
            hits = [found_terms(a, (u or "").translate(low)) for u in b.column("url").to_pylist()]
            weights = pa.array([sum(h.values()) for h in hits], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], weights, pa.array([sorted(h) for h in hits], pa.list_(pa.string()))], ["page_id", "host", "path", "weight", "terms"])

    ids = pages.schema["page_id"].dataType.simpleString()
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = pages.select("page_id", F.translate(F.regexp_extract(url, at, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, at, 2).alias("path"), "url")
    out = parts.mapInArrow(weigh, f"page_id {ids}, host string, path string, weight int, terms array<string>")
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule stands outside a shorter one
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("weight") >= soft_limit, "block").otherwise("allow")).alias("verdict"), "weight", "terms")


def url_filter_sql() -> str:
    """The same as DuckDB SQL."""
    term = lambda t: rf"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    terms = ", ".join(f"CASE WHEN {term(t)} THEN '{t}' END" for t in sorted({*STRICT, *SOFT}))
    weight = " + ".join([*(f"{SOFT_LIMIT} * {term(t)}::INT" for t in STRICT), *(f"{term(t)}::INT" for t in SOFT)])
    cases = {n: " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v if n else r}'" for v, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1]))) for n in (0, 1)}
    return rf"""
        WITH p AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
                          translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
             w AS (SELECT *, ({weight})::INT AS weight, list_filter([{terms}], lambda x: x IS NOT NULL) AS terms FROM p)
        SELECT page_id, host, path, CASE {cases[0]} END AS rule,
               CASE {cases[1]} ELSE CASE WHEN weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END END AS verdict, weight, terms
        FROM w"""
