from collections import defaultdict

import pytest

from fringework.llm import mixing as M


def brute(rows, rounds=60, power=M.TEMPERATURE):
    """Plain raking of (source, lang, topic, tokens)."""
    cells = defaultdict(int)
    for *cell, tokens in rows:
        cells[tuple(cell)] += tokens
    cells = {c: t for c, t in cells.items() if t}
    goals = []
    for d in range(3):
        sums = defaultdict(float)
        for c, t in cells.items():
            sums[c[d]] += t
        total = sum(s**power for s in sums.values())
        goals.append({k: s**power / total for k, s in sums.items()})
    w = dict(cells)
    for _ in range(rounds):
        for d in range(3):
            sums = defaultdict(float)
            for c, v in w.items():
                sums[c[d]] += v
            w = {c: v * goals[d][c[d]] / sums[c[d]] for c, v in w.items()}
    return w, goals


KINDS = ["one two " * 9, "a1 b22 <c> 33 " * 90, "| x | y |\n" * 400, "word " * 300, "long words " * 500, "- item\n" * 9]
DOCS = [(i, KINDS[i % 6] * (i % 4 + 1), ["de", "en", None][i % 5 % 3], ["src0", "src1", "", None, "src0"][i % 7 % 5], "clash") for i in range(160)]
DOCS += [(900, None, "en", "src0", "c"), (901, "", None, None, "c"), (None, "null key", "en", "src1", "c"), (3, DOCS[3][1], "de", "src0", "again")]
SCHEMA = "doc_id long, text string, lang string, source string, weight string"


def test_weights_against_plain_raking(spark):
    rows = M.weighted(spark.createDataFrame(DOCS, SCHEMA)).collect()
    assert len(rows) == len(DOCS)
    w, goals = brute([(r.source, r.lang, r.topic, r.n_tokens) for r in rows])
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source, r.lang, r.topic] += r.n_tokens
    total = sum(tokens.values())
    factors = {c: v * total / tokens[c] for c, v in w.items()}
    most = max(factors.values())
    for r in rows:
        f = factors.get((r.source, r.lang, r.topic))
        assert r.weight == pytest.approx(f if f else 1.0, abs=2e-6)
        assert r.probability == pytest.approx(f / most if f else 1.0, abs=2e-6)
    assert {r.topic for r in rows} == {"figures", "markup", "list", "prose", "long prose"}
    # Every margin is met.
    for d, slack in ((2, 1e-9), (1, 1e-9), (0, 1e-9)):
        sums = defaultdict(float)
        for c, v in w.items():
            sums[c[d]] += v
        assert all(abs(sums[k] - g) < slack for k, g in goals[d].items())


def test_given_targets_shape_the_mix(spark):
    df = spark.createDataFrame([(i, "a b c d", "en", f"s{i % 4 // 3}") for i in range(4000)], "doc_id long, text string, lang string, source string")
    kept = M.mixed(df, targets={"source": {"s0": 1, "s1": 1}})
    assert kept.columns == df.columns
    n = {r.source: r["count"] for r in kept.groupBy("source").count().collect()}
    assert n["s1"] == 1000 and 850 < n["s0"] < 1150
    again = {r.doc_id for r in M.mixed(df, targets={"source": {"s0": 1, "s1": 1}}).collect()}
    assert again == {r.doc_id for r in kept.collect()}


def test_empty_and_textless(spark):
    assert M.weighted(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [(r.probability, r.selected) for r in M.weighted(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()] == [(1.0, True)]


def test_expected_tokens_meet_every_margin(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    rows, names = M._cells_of(docs, "text", None)
    cells = M.cell_totals(rows, names)
    fit = M.calibrated(cells)
    assert fit.agg({"residual": "max"}).first()[0] <= M.TOLERANCE
    given = {"source": {"src0": 2, "src1": 1, "gone": 5}}
    got = M.calibrated(cells, targets=given).join(cells, list(M.DIMENSIONS)).selectExpr("source", "weight * tokens AS w").groupBy("source").sum("w").collect()
    sums = {r[0]: r[1] for r in got if r[1]}
    assert sums["src0"] == pytest.approx(2 * sums["src1"]) and set(sums) == {"src0", "src1"}


def test_contradicting_targets_leave_a_residual(spark):
    docs = spark.createDataFrame([(1, "a b", "de", "x"), (2, "c d", "en", "y")], "doc_id long, text string, lang string, source string")
    rows, names = M._cells_of(docs, "text", None)
    fit = M.calibrated(M.cell_totals(rows, names), targets={"source": {"x": 3, "y": 1}, "lang": {"de": 1, "en": 1}}, rounds=8)
    assert fit.agg({"residual": "max"}).first()[0] > 0.1


def test_clashing_names_come_back_as_they_were(spark):
    names = ["doc_id", "text", "lang", "source", "topic", "tokens", "_tokens", "weight", "_probability", "probability", "_source", "Topic_"]
    docs = spark.createDataFrame([(i, "a b c", "en", "s", *(f"own{j}" for j in range(8))) for i in range(5)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert [tuple(r) for r in M.mixed(docs).orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
    assert M.weighted(docs).count() == 5


def test_own_topics_and_a_very_long_text(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * (400_000 if i == 0 else 5), "en", "s") for i in range(8)], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in M.weighted(docs, topic=F.when(F.col("doc_id") > 3, "a")).collect()}
    assert rows[0].n_tokens == 400_000 and (rows[0].topic, rows[4].topic) == (M.UNKNOWN, "a")
