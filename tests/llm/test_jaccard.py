import random

import corpus_pipeline
from fringework.llm import simhash as S


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def least_of_groups(rows):
    """Brute force: all pairs."""
    sets = {i: runs(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and likeness(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(i for i in sets if find(i) == i)


def edited_copies(seed=5):
    """Texts, and copies of each with a few words replaced: likenesses on both sides of 0.8."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(40):
        words = [f"w{rnd.randrange(5_000)}" for _ in range(rnd.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 6)):
            copy = list(words)
            for _ in range(rnd.randint(1, max(2, len(words) // 25))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(5_000)}"
            texts.append(" ".join(copy))
    texts += ["", None, " ", "one two", "One  TWO", "one three"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_the_stage_removes_edited_copies(spark):
    rows = edited_copies()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    want = least_of_groups(rows)
    assert len(want) < len(rows) - 40
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == want


def test_shards_lose_nothing(spark):
    rows = edited_copies(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.kept(docs, shard_members=300).collect()) == least_of_groups(rows)


def test_repeated_rows_null_keys_and_empty(spark):
    body = " ".join(f"w{i}" for i in range(300))
    rows = [(7, body), (3, body.upper()), (3, body.upper()), (None, body), (None, "a lonely text"), (9, body + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in S.kept(docs).collect()), key=repr) == [3, None]
    assert S.kept(docs.limit(0)).count() == 0


def test_clashing_names_and_string_keys(spark):
    body = " ".join(f"w{i}" for i in range(300))
    rows = [("b", body, 1, 2, 3, "t"), ("a", body.upper(), 4, 5, 6, "t"), (None, "alone", 7, 8, 9, "t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, row int, _key int, _row int, _text string")
    got = S.kept(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [rows[1], rows[2]]


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "SHINGLES_AT_ONCE", 1 << 12)
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-100])), (3, " ".join(words[30_000:]))]
    assert sorted(r.doc_id for r in S.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]
