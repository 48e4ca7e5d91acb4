"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every match must
contain. Token frequencies are counted over all URLs; each rule is filed under
the rarest of its tokens. A URL fetches the rules filed under its own tokens and
only those run their expression. Only DataFrame functions are used.

Cases: a null URL, or one without ``://``, has empty host and path and no
tokens, so it gets the default verdict. Rows that repeat are judged alike; every
input row keeps its own output row, one with a null key too. Very long URLs are
judged whole. Of patterns that match, the first listed decides; of rules that fit,
the longest. Columns of the input other than the key and the URL are ignored,
whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.llm.shared import table

BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` runs on host + path + ``?`` + query, host lower-cased.

    ``tokens`` are maximal runs of letters and digits (lower-cased) that stand in every match.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    action: str = BLOCK


#: The host and path rules that every run applies.
HOST_RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))


def _whole(words: str) -> str:
    return f"(?:^|[^a-z0-9]){words}(?:[^a-z0-9]|$)"


#: Pattern rules of the method, for URLs that no host rule fits.
PATTERN_RULES = (
    PatternRule("casino", _whole("casino"), ("casino",)),
    PatternRule("free-bets", _whole("free-bets"), ("free", "bets")),
    PatternRule("cheap-pills", _whole("cheap-pills"), ("cheap", "pills")),
    PatternRule("payday-loans", _whole("payday-loans"), ("payday", "loans")),
    PatternRule("replica-watches", _whole("replica-watches"), ("replica", "watches")),
    PatternRule("ad-server", r"^(?:[^/?]*\.)?ads\.", ("ads",)),
    PatternRule("tracking-pixel", r"/pixel\.gif(?:[?]|$)", ("pixel", "gif")),
    PatternRule("session-id", r"[?&]phpsessid=[0-9a-f]+", ("phpsessid",)),
)

#: Up to this many rules the index is a map literal in the plan; beyond it, a join on the token.
LITERAL_RULES = 1_000


def host_rule(rule: str, action: str) -> PatternRule:
    """``example.net/en/`` as a pattern: the host and its subdomains, the path by prefix."""
    host, slash, path = rule.partition("/")
    pattern = rf"^(?:[^/?]*\.)?{re.escape(host)}" + (re.escape(slash + path) if slash else r"(?:/|[?]|$)")
    # The last part of the path may go on in the URL, so it is no whole token there.
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return PatternRule(rule, pattern, tuple(whole), action)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; all empty for a null URL or one without ``://``."""
    raw = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(raw, "://")
    rest = F.when(at > 0, F.substring(raw, at + 3, F.length(raw))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*[?]([^#]*)", 1)
    return lowered, path, query


def _tokens(target: Column) -> Column:
    # Expressions take a capital for the edge of a word, so runs are cut from the target as it stands too.
    runs = [F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), F.lit(1)) for t in (target, F.lower(target))]
    return F.array_union(*runs)


def rarest_tokens(targets: DataFrame, rules: Sequence[PatternRule]) -> dict[str, int]:
    """For each literal token of the rules, the number of rows of ``targets`` that hold it.

    The result has a row per token of a rule at most, so it is as bounded as the rules.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    held = F.array_intersect("tokens", F.array(*map(F.lit, literals)))
    rows = targets.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(literals, 0) | {r["token"]: r["count"] for r in rows}


def filed(rules: Sequence[PatternRule], counts: dict[str, int]) -> list[tuple[str, int]]:
    """(token, rule number) with each rule under the rarest of its tokens, ties by the token's text."""
    return [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), i) for i, r in enumerate(rules)]


def judged(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    host_rules: Sequence[tuple[str, str]] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
    default: str = ALLOW,
    literal_rules: int = LITERAL_RULES,
) -> DataFrame:
    """A row per page: key, host, path, rule, verdict, pattern, candidates.

    Of the host rules that fit, the longest wins (``rule``). Where none fits, the
    first blocking pattern rule that matches is named in ``pattern`` and blocks,
    else the verdict is ``default``. ``candidates`` is the number of rules whose
    expression ran. With the index as a literal the plan has no shuffle at all.
    """
    spark = pages.sparkSession
    rules = [*(host_rule(r, a) for r, a in host_rules), *pattern_rules]
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token cannot be indexed")
    host, path, query = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"), query.alias("_query"))
    tail = F.when(F.col("_query") != "", F.concat(F.lit("?"), F.col("_query"))).otherwise(F.lit(""))
    rows = rows.withColumn("_target", F.concat("host", "path", tail)).withColumn("tokens", _tokens(F.col("_target")))
    index = filed(rules, rarest_tokens(rows, rules))
    rank = lambda i: (0, -len(rules[i].name), rules[i].name) if i < len(host_rules) else (1, i, "")
    order = {i: place for place, i in enumerate(sorted(range(len(rules)), key=rank))}
    record = lambda i: (order[i], rules[i].name, rules[i].pattern, rules[i].action, i < len(host_rules))
    if len(rules) <= literal_rules:
        by_token: dict[str, list[int]] = {}
        for token, i in index:
            by_token.setdefault(token, []).append(i)
        entry = lambda i: F.struct(*(F.lit(v).alias(n) for v, n in zip(record(i), ("place", "name", "pattern", "action", "is_host"), strict=True)))
        lookup = F.create_map(*(c for t, ids in by_token.items() for c in (F.lit(t), F.array(*map(entry, ids)))))
        fetched = F.flatten(F.transform(F.filter("tokens", lambda t: t.isin(*by_token)), lambda t: lookup[t]))
        rows = rows.withColumn("_fetched", fetched)
        fit = F.filter("_fetched", lambda r: F.regexp_like("_target", r["pattern"]))
        rows = rows.withColumn("_fit", fit).withColumn("candidates", F.size("_fetched").cast("long"))
    else:
        schema = "token string, place int, name string, pattern string, action string, is_host boolean"
        filed_rules = spark.createDataFrame([(t, *record(i)) for t, i in index], schema)
        keyed = rows.select("_target", "tokens").where("_target <> ''").dropDuplicates(["_target"])
        fetched = keyed.select("_target", F.explode("tokens").alias("token")).join(filed_rules, "token")
        hit = F.regexp_like("_target", F.col("pattern"))
        found = fetched.groupBy("_target").agg(
            F.collect_set(F.when(hit, F.struct("place", "name", "pattern", "action", "is_host"))).alias("_fit"),
            F.count("*").alias("candidates"),
        )
        rows = rows.join(found, "_target", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        rows = rows.withColumn("_fit", F.coalesce("_fit", F.filter(F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("name"), F.lit("").alias("pattern"), F.lit("").alias("action"), F.lit(False).alias("is_host"))), lambda r: F.lit(False))))
    best = rows.withColumn("_best", F.array_min("_fit"))
    is_host = F.coalesce(F.col("_best.is_host"), F.lit(False))
    return best.select(
        key,
        "host",
        "path",
        F.when(is_host, F.col("_best.name")).alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
        F.when(~is_host, F.col("_best.name")).alias("pattern"),
        "candidates",
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).drop("candidates")


def _sql() -> str:
    rule = lambda r: (r.partition("/")[0], "/" + r.partition("/")[2])
    fits = lambda r: f"((host = '{rule(r)[0]}' OR ends_with(host, '.{rule(r)[0]}')) AND starts_with(path, '{rule(r)[1]}'))"
    ordered = sorted(HOST_RULES, key=lambda x: (-len(x[0]), x[0]))
    pick = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{a}'" for r, a in ordered)
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(target, '{r.pattern}') THEN '{r.name}'" for r in PATTERN_RULES) + " END"
    return f"""
WITH raw AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages
), rest AS (
  SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM raw
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM rest
), targets AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS target FROM parts
), told AS (
  SELECT *, {pick} AS rule, {pattern} AS hit FROM targets
)
SELECT page_id, host, path, rule,
       {action} WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS pattern
FROM told
"""


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLE_SQL = {"op9_url_filters": _sql()}
