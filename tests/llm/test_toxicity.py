import random
import zlib

from fringework.llm import toxicity as X

INSULTS = ["dreckskerl", "nichtsnutz", "hohlkopf", "widerling"]


def corpus(n=420, seed=0):
    rnd = random.Random(seed)
    syllables = ["an", "er", "the", "ing", "on", "at", "is", "re", "nd", "ou", "st", "le"]
    rows = []
    for i in range(n):
        toxic = rnd.random() < 0.3
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 300))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rnd.randrange(len(words))] = rnd.choice(INSULTS)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def write(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_held_out_accuracy_and_edge_cases(spark, tmp_path):
    rows = corpus()
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "ordinary " * 40_000 + "dreckskerl nichtsnutz hohlkopf widerling " * 8, "x"), (None, "the ring", None), (3, rows[3][1], "again")]
    sf = write(spark, tmp_path, [(i, t, "clash") for i, t, _ in rows] + odd, [(i, 1, y) for i, _, y in rows] + [(1001, 1, None), (7777, 0, 1)])
    got = X.op8_toxicity(spark, sf).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    told = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in told) / len(told) > 0.9
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score and not by_id[1001].predicted
    clean = X.kept(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert clean.columns == ["doc_id", "text", "score"]
    flagged = {r.doc_id for r in got if r.predicted}
    assert clean.count() == sum(r.doc_id not in flagged for r in got)


def test_without_labels_nothing_is_toxic(spark, tmp_path):
    sf = write(spark, tmp_path, [(1, "a b", "")], [(1, 1, 1)])
    assert [r.score for r in X.op8_toxicity(spark, sf).collect()] == [0.0]
    sf = write(spark, tmp_path / "empty", [], [])
    assert X.op8_toxicity(spark, sf).count() == 0


def test_windows_cover_the_whole_text():
    data = bytes(range(256)) * 9
    got = X.windows(data)
    assert b"".join(w[: X.STRIDE] for w in got[:-1]) + got[-1] == data and X.windows(b"") == [b""]


def test_scores_against_a_plain_version(spark, tmp_path):
    """Window by window, with compressors and calibration written out."""
    import math

    import zstandard

    rows = corpus(300, seed=7)
    sf = write(spark, tmp_path, [(i, t, "") for i, t, _ in rows] + [(2000, "", ""), (2001, "x" * 5_000, "")], [(i, 1, y) for i, _, y in rows])
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = X.fitted(*X.training_sample(docs, labels))

    def length(data, dictionary):
        p = zstandard.ZstdCompressionParameters.from_level(3, source_size=256, dict_size=len(dictionary), min_match=5, hash_log=17, window_log=17, strategy=zstandard.STRATEGY_FAST, target_length=1, write_content_size=False, write_checksum=False, write_dict_id=False)
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), compression_params=p).compress(data))

    for r in X.op8_toxicity(spark, sf).collect():
        data = dict([(i, t) for i, t, _ in rows] + [(2000, ""), (2001, "x" * 5_000)])[r.doc_id].lower().encode()
        saved, at = [], 0
        while True:
            window = data[at : at + 256]
            saved.append(length(window, m.ordinary) - length(window, m.ordinary + m.toxic))
            at += 240
            if at >= len(data) - 16:
                break
        n, over = len(saved), [max(0, s - 2) for s in saved]
        x = [min(max(saved), 12), min(sum(saved) / n, 6), math.log1p(max(0, sum(saved))), math.log1p(sum(over)), sum(s >= 4 for s in saved) / n, math.log1p(sum(s >= 6 for s in saved)), math.log(n), sum(s >= 1 for s in saved) / n]
        z = m.weights[0] + sum(w * (v - a) / b for w, v, a, b in zip(m.weights[1:], x, m.means, m.scales, strict=True)) + m.shift
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_clashing_names(spark, tmp_path):
    rows = corpus(120, seed=2)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in rows], "doc_id long, text string, score int, _text int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = X.fitted(*X.training_sample(docs, labels))
    got = X.scored(docs, model, "doc_id", "text", "score", "_text")
    assert got.columns == ["doc_id", "score", "_text", "_score"] and got.where("score = 1 AND _text = 2 AND _score BETWEEN 0 AND 1").count() == 120
