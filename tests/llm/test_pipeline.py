import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fringework.llm import bpe, mixing, toxicity  # noqa: E402
from tests.llm.test_jaccard import least_of_groups  # noqa: E402
from tests.llm.test_toxicity import corpus  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    texts = corpus(260, seed=3)
    near = " ".join(f"word{i}" for i in range(400))
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in texts]
    rows += [(1000 + i, near.replace(f"word{i * 9} ", "other "), "de", "src0", len(near)) for i in range(30)] + [(2000, None, None, None, 0), (2001, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    # Toxicity: row by row with the same model.
    model = toxicity.fitted(*toxicity.training_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    score = model.scorer()
    left = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    toxic = {i for i, _, y in texts if y}
    assert sum(r[0] in toxic for r in left) < 0.3 * len(toxic)
    # Near duplicates: all pairs.
    stay = set(least_of_groups([(r[0], r[1]) for r in left]))
    left = [r for r in left if r[0] in stay]
    assert sum(r[0] >= 1000 for r in left) == 2
    mixed = mixing.mixed(spark.createDataFrame(left, docs.schema)).collect()
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in mixed}
    arrays, _ = bpe.read_vocabulary(bpe.default_vocabulary())
    merge = bpe.Merges(arrays["start"], arrays["merges"])
    by_id = {r[0]: r for r in left}
    for r in got:
        text = by_id[r.doc_id][1] or ""
        ids = [x for w in bpe._ANY(text) for x in merge.ids(w.encode())]
        assert list(r.tokens) == ids and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "bpe"]


def test_empty_tables_null_keys_and_clashing_names(spark, tmp_path):
    texts = corpus(120, seed=4)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, weight int, token_ids int, _text int"
    rows = [(i, t, "en", "s", len(t), 1, 2, 3, 4) for i, t, _ in texts] + [(None, "null key", None, None, 8, 1, 2, 3, 4), (None, None, None, None, 0, 1, 2, 3, 4)]
    labels = [(i, 1, y) for i, _, y in texts]
    for name, mine, told in (("clash", rows, labels), ("unlabelled", rows, []), ("empty", [], [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(mine, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert bool(got) == bool(mine) and all((r._row, r.weight, r["_text"]) == (1, 2, 4) for r in got)
        assert not mine or sum(r.doc_id is None for r in got) >= (name == "unlabelled")
