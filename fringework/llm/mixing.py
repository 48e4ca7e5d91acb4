"""Mixing sources to target weights by iterative proportional fitting.

Documents are cells of a contingency table by source, language and topic. The
table's token weights are raked: each round scales the cells so that the sums of
one dimension after another meet their targets, until every margin is met or the
rounds are used up. A cell's factor is its raked weight over its tokens;
documents are drawn with a probability proportional to it, calibrated so that
the expected tokens meet every margin at once, and a document's draw depends on
its key and a seed alone. Only DataFrame functions are used; the table is
aggregated before anything moves, so a source that holds a third of all rows is
a few cells.

Probabilities are factors over the largest factor, so no document is drawn
twice. The price is that one cell whose target is far above its share lowers the
probability of all others: the drawn share of all tokens is one over the largest
factor.

Cases: null sources and languages are values of their own (``UNKNOWN``), as are
empty ones; null and empty texts have no tokens and go with their cell's factor; a
null key is drawn by the empty string's hash; repeated rows are drawn alike; a
very long text counts with all its words. Extra columns are carried along by
``mixed`` and ignored by ``weighted``, whatever their names: helper columns get
names that the table does not have. Empty tables give no rows. A dimension
without given targets gets its shares to the power ``TEMPERATURE``; of given
targets those of values without tokens fall away and the rest are scaled to one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringework.llm.shared import dropped, free_names, table, written

UNKNOWN = "unknown"
#: Raking ends when no margin is off by more than this share of its target, or after so many rounds.
TOLERANCE, ROUNDS = 1e-9, 96
#: Rounds in one plan; after each such run the table is written and its largest residual is read.
ROUNDS_AT_ONCE = 4
#: Targets are the shares to this power, scaled to one: below 1 they lift what is rare.
TEMPERATURE = 0.9
SEED = "mix-1"
#: Cells may be broadcast, or raked by one task, up to this many (about 100 bytes each).
BROADCAST_CELLS = 100_000

DIMENSIONS = ("source", "lang", "topic")

#: A text's topic is the first of these that fits: kind, a pattern, and the words there may be to one match of it at most.
TOPICS = (("figures", "[0-9]+", 12), ("markup", r"[<>{}\[\]=|#/_*\\]", 8))
#: Bytes a line has in a list at most, and the fewest lines of one; bytes from which on prose is long.
LIST_LINE, LIST_LINES, LONG_PROSE = 80, 4, 4_000


def n_tokens(text: Column) -> Column:
    """Runs of other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")).cast("long")


def topic(text: Column) -> Column:
    """What a text is made of: figures, markup, lists, or prose by its length.

    A default by form, for corpora without subject labels; callers that have
    better topics give their own column.
    """
    t, words = F.coalesce(text, F.lit("")), n_tokens(text)
    size, lines = F.octet_length(t), F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    out = F.when(size == 0, "prose")
    for kind, pattern, most in TOPICS:
        out = out.when((F.regexp_count(t, F.lit(pattern)) * most >= words) & (words > 0), kind)
    return out.when((lines >= LIST_LINES) & (size < LIST_LINE * lines), "list").when(size >= LONG_PROSE, "long prose").otherwise("prose")


def _cells_of(docs: DataFrame, text: str, kind: Column | None) -> tuple[DataFrame, list[str]]:
    """``docs`` with four columns of free names: source, lang, topic and tokens."""
    names = free_names(docs.columns, *DIMENSIONS, "tokens")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    own = topic(F.col(text)) if kind is None else F.coalesce(kind.cast("string"), F.lit(UNKNOWN))
    return docs.withColumns(dict(zip(names, (known("source"), known("lang"), own, n_tokens(F.col(text))), strict=True))), names


def cell_totals(rows: DataFrame, names: list[str]) -> DataFrame:
    """(source, lang, topic, tokens, docs) of rows whose cell and tokens stand in the columns ``names``."""
    *cell, tokens = names
    return rows.groupBy(*(F.col(n).alias(d) for n, d in zip(cell, DIMENSIONS, strict=True))).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))


def _with_targets(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], temperature: float) -> DataFrame:
    """``cells`` with the target share of its value in each dimension."""
    wants, parts = [], []
    for d in DIMENSIONS:
        by = Window.partitionBy(d)
        if d in targets:
            pairs = [F.lit(x) for k, v in targets[d].items() for x in (k, float(v))]
            want = F.coalesce(F.create_map(*pairs)[F.col(d)], F.lit(0.0)) if pairs else F.lit(0.0)
        else:
            want = F.pow(F.sum("tokens").over(by).cast("double"), F.lit(temperature))
        wants.append(want.alias(f"{d}_want"))
        parts.append(F.count(F.lit(1)).over(by).alias(f"{d}_n"))
    # Each cell adds its part of its value's weight, so that a value counts once.
    cells = cells.select("*", *wants, *parts)
    total = cells.agg(*(F.sum(F.col(f"{d}_want") / F.col(f"{d}_n")).alias(d) for d in DIMENSIONS)).first()
    return cells.select(*DIMENSIONS, "tokens", "docs", *((F.col(f"{d}_want") / F.lit(total[d] or 1.0)).alias(f"{d}_share") for d in DIMENSIONS))


def _round_sql(rounds: int) -> str:
    """So many rounds over the table ``cells`` as one statement, which is analysed once."""
    shares = ", ".join(f"{d}_share" for d in DIMENSIONS)
    fixed = ", ".join(DIMENSIONS) + f", tokens, docs, {shares}"
    off = ", ".join(f"off_{d}" for d in DIMENSIONS)
    out = f"SELECT {fixed}, weight, {', '.join(f'0.0D AS off_{d}' for d in DIMENSIONS)} FROM {{cells}}"
    for _ in range(rounds):
        for d in DIMENSIONS:
            offs = ", ".join(f"CASE WHEN s > 0 AND {d}_share > 0 THEN abs(s / {d}_share - 1) ELSE 0.0D END AS off_{d}" if d == e else f"off_{e}" for e in DIMENSIONS)
            out = f"SELECT {fixed}, CASE WHEN s > 0 THEN weight * {d}_share / s ELSE 0.0D END AS weight, {offs} FROM (SELECT *, sum(weight) OVER (PARTITION BY {d}) AS s FROM ({out}))"
    return f"SELECT {fixed}, weight, greatest({off}) AS residual FROM ({out})"


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, lang, topic, tokens, docs, weight, residual) of the cells with tokens.

    ``weight`` is the cell's raked share of all tokens; ``residual`` the largest
    deviation, as a share of the target, that the last round still found in a
    margin of the cell. Targets that contradict each other leave it above
    ``tolerance``. A step is a windowed sum over the cells by one dimension; a
    table of up to ``BROADCAST_CELLS`` cells is one partition, so its windows
    need no shuffle.
    """
    targets = {d: t for d, t in (targets or {}).items() if t is not None}
    filled = cells.where("tokens > 0")
    few = filled.count() <= BROADCAST_CELLS
    held = lambda df: df.coalesce(1) if few else df
    now = held(_with_targets(held(filled), targets, temperature)).withColumn("weight", F.col("tokens").cast("double"))
    done, last = 0, None
    while done < rounds:
        steps = min(ROUNDS_AT_ONCE, rounds - done)
        now, done = held(written(held(now.sparkSession.sql(_round_sql(steps), cells=now)), "raked")), done + steps
        if last is not None:
            dropped(now.sparkSession, last)
        last = now
        if (now.agg(F.max("residual").alias("r")).first()["r"] or 0.0) <= tolerance:
            break
    return now.drop(*(f"{d}_share" for d in DIMENSIONS))


def calibrated(cells: DataFrame, **fit) -> DataFrame:
    """(source, lang, topic, weight, probability, residual) of every cell.

    ``weight`` is the factor between the raked and the given share; a probability
    is the factor over the largest factor, so none exceeds one and the expected
    tokens keep the raked shares. Cells without tokens are kept whole.
    """
    every = written(cells, "cells")
    now = raked(every, **fit)
    told = now.agg(F.sum("tokens").alias("t"), F.max(F.col("weight") / F.col("tokens")).alias("m")).first()
    factor = F.col("weight") * F.lit(float(told["t"] or 1)) / F.col("tokens")
    most = (told["m"] or 0.0) * float(told["t"] or 1) or 1.0
    known = now.select(*DIMENSIONS, factor.alias("weight"), (factor / F.lit(most)).alias("probability"), "residual")
    rest = every.where("coalesce(tokens, 0) <= 0").select(*DIMENSIONS, F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"), F.lit(0.0).alias("residual"))
    out = written(known.unionByName(rest), "cell-factors")
    dropped(out.sparkSession, every)
    dropped(out.sparkSession, now)
    return out


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 that depends on the key and the seed alone (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def weighted(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None, **fit) -> DataFrame:
    """A row per row of ``docs``: key, source, lang, topic, n_tokens, weight, probability, selected; texts are read once."""
    rows, names = _cells_of(docs, text, topic)
    seen = written(rows.select(F.col(key).alias("key"), *(F.col(n).alias(d) for n, d in zip(names, (*DIMENSIONS, "n_tokens"), strict=True))), "cells-by-row")
    factors = calibrated(cell_totals(seen, [*DIMENSIONS, "n_tokens"]), **fit).drop("residual")
    if factors.count() <= BROADCAST_CELLS:
        factors = F.broadcast(factors)
    drawn = seen.join(factors, list(DIMENSIONS), "left")
    return drawn.select(
        F.col("key").alias(key), *DIMENSIONS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), (draw(F.col("key")) < F.col("probability")).alias("selected")
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None, **fit) -> DataFrame:
    """The drawn rows of ``docs`` with its columns; texts are read and do not move."""
    rows, names = _cells_of(docs, text, topic)
    factors = calibrated(cell_totals(rows, names), **fit)
    chance = free_names(rows.columns, "probability")[0]
    factors = factors.select(*(F.col(d).alias(n) for d, n in zip(DIMENSIONS, names, strict=False)), F.col("probability").alias(chance))
    if factors.count() <= BROADCAST_CELLS:
        factors = F.broadcast(factors)
    return rows.join(factors, names[:3], "left").where(draw(F.col(key)) < F.col(chance)).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(table(spark, sf_dir, "documents"))


#: Rounds of the SQL twin, which cannot stop by itself; the tables at hand are met within them.
SQL_ROUNDS = 24


def sql_from(documents: str, columns: str) -> str:
    """DuckDB text of :func:`weighted` over a table; ``columns`` picks what is returned."""
    steps, last = [], "fit0"
    for r in range(SQL_ROUNDS):
        for d in DIMENSIONS:
            name = f"fit{r}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (weight * {d}_share / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = name
    shares = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d})::DOUBLE, {TEMPERATURE}) AS {d}_w" for d in DIMENSIONS)
    # The sum of a value's power over distinct values: each cell adds its part of it.
    whole = ", ".join(f"{d}_w / (SELECT sum(w) FROM (SELECT DISTINCT {d}, {d}_w AS w FROM tempered)) AS {d}_share" for d in DIMENSIONS)
    marks = "".join(f" WHEN len(regexp_extract_all(t, '{pattern}')) * {most} >= c_tokens AND c_tokens > 0 THEN '{kind}'" for kind, pattern, most in TOPICS)
    return f"""
texts AS (SELECT *, coalesce(text, '') AS t, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines, len(regexp_extract_all(t, '[^ \t\n\r]+'))::BIGINT AS c_tokens FROM {documents}),
told AS (
  SELECT *, coalesce(source, '{UNKNOWN}') AS c_source, coalesce(lang, '{UNKNOWN}') AS c_lang,
    CASE WHEN t = '' THEN 'prose'{marks} WHEN n_lines >= {LIST_LINES} AND strlen(t) < {LIST_LINE} * n_lines THEN 'list'
         WHEN strlen(t) >= {LONG_PROSE} THEN 'long prose' ELSE 'prose' END AS c_topic
  FROM texts
), cells AS (
  SELECT c_source AS source, c_lang AS lang, c_topic AS topic, sum(c_tokens)::BIGINT AS tokens FROM told GROUP BY ALL
), tempered AS (SELECT *, {shares} FROM cells WHERE tokens > 0),
fit0 AS (SELECT *, tokens::DOUBLE AS weight, {whole} FROM tempered),
{", ".join(steps)},
factors AS (SELECT source, lang, topic, weight * (SELECT sum(tokens) FROM cells) / tokens AS factor FROM {last}),
drawn AS (
  SELECT told.*, coalesce(factor, 1.0) AS factor, coalesce(factor / (SELECT max(factor) FROM factors), 1.0) AS probability,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}.0 AS u
  FROM told LEFT JOIN factors ON c_source = factors.source AND c_lang = factors.lang AND c_topic = factors.topic
)
SELECT {columns}
"""


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL = {
    "op3_mixing": "WITH "
    + sql_from("documents", "doc_id, c_source AS source, c_lang AS lang, c_topic AS topic, c_tokens AS n_tokens, round(factor, 6) AS weight, round(probability, 6) AS probability, u < probability AS selected FROM drawn")
}
