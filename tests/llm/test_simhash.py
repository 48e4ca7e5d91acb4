import random

import numpy as np
import xxhash

from fringework.llm import simhash as S
from fringework.operators.graph import components


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, docs):
    """Brute force: all pairs."""
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for f, d in zip(fps, docs, strict=True):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for f in fps]


def test_fingerprint_matches_the_plain_one():
    rnd = random.Random(3)
    for text in ["", None, " \t", "One", "a B", "A b C", "Ä ä X y z z z z", " ".join(rnd.choice("abcde") for _ in range(500))]:
        assert S.fingerprint(text) == plain(text)


def test_the_code_is_perfect_and_every_near_pair_meets_at_a_home():
    low, high, _, by_excess = S.code_tables()
    assert (by_excess[0][2] == 1).all()
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**64, 400, dtype=np.uint64)
    flips = [1 << int(x) | 1 << int(y) for x, y in rnd.integers(0, 64, (400, 2))]
    b = a ^ np.array(flips, dtype=np.uint64)
    at, anchor, home = S.anchors(a)
    homes = dict(zip(at[home], anchor[home], strict=True))
    assert len(homes) == 400
    at, anchor, _ = S.anchors(b)
    reached = set(zip(at.tolist(), anchor.tolist(), strict=True))
    assert all((i, int(homes[i])) in reached for i in range(400))
    assert len(reached) == len(at)


def fps_with_chains(n=1500):
    rnd = random.Random(1)
    out = [0, 3, 15, (1 << 64) - 1]
    for _ in range(n):
        f = rnd.getrandbits(64)
        out.append(f)
        for _ in range(rnd.choice([0, 0, 1, 4])):
            for _ in range(rnd.choice([1, 2, 3])):
                f ^= 1 << rnd.randrange(64)
            out.append(f)
    centre = rnd.getrandbits(64)
    out += [centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)]
    return out


def test_groups_against_all_pairs(spark):
    fps = fps_with_chains()
    docs = list(range(len(fps)))
    random.Random(2).shuffle(docs)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame(list(zip(docs, signed, strict=True)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in S.grouped(df).collect()}
    assert [got[f] for f in signed] == roots(fps, docs)


def test_shards_lose_nothing(spark):
    fps = fps_with_chains(200)
    signed = sorted({int(np.uint64(f).view(np.int64)) for f in fps})
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    few, many = ({(r.node, r.component) for r in components(S.links(df, n)).collect()} for n in (10**9, 5))
    assert few == many and few


def test_query_and_kept_rows(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(300))
    rows = [(7, body, "x"), (3, body, "y"), (3, body, "y"), (9, body.upper(), "z"), (1, None, None), (2, " ", ""), (None, "only here now", "n"), (None, "and another one there", "n"), (4, "quite different text stands here", "q")]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.op1_simhash(spark, str(tmp_path)).collect()), key=repr)
    fps = [plain(t) for _, t, _ in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, *_), f, c in zip(rows, fps, roots(fps, [r[0] for r in rows]), strict=True)), key=repr)
    assert got == want
    kept = S.kept(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, 4, None, None]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.kept(df).count() == 0
