import hashlib
import random

import pytest

from fringework.llm import bpe as B

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

SPECIMENS = [
    None, "", " ", "Hello world", "  two  spaces ", "it's we'll I'd", "\n\n\t tab\r\n", "\x1c\x1d\x85 ​\xa0x", "café naïve ß",
    "\U0001f600\U0001f680 ok", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof text|>", "x" * 3000, "ab" * 700 + " " * 50 + "cd",
    "1234567 89,000.5", "你好世界", "क्ष กำ", "á̧", "\x00\x01\x7f",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.default_vocabulary())


def test_query_equals_the_library(spark, tmp_path, library):
    rnd = random.Random(5)
    alphabet = "abc DEéü 0\n'<|>　\U0001f600"
    texts = SPECIMENS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null key", "x"), (3, "Hello world", "again")]
    spark.createDataFrame(rows, "doc_id long, text string, token_ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op2_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        joined, back = ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_long_and_short_merging_agree():
    arrays, _ = B.read_vocabulary(B.default_vocabulary())
    merge = B.Merges(arrays["start"], arrays["merges"])
    rnd = random.Random(1)
    for _ in range(200):
        ids = [merge.start[rnd.choice(b"aabhetinors ")] for _ in range(rnd.randint(2, 60))]
        assert merge._short(list(ids)) == merge._long(list(ids))


def test_automaton_numbers_words_in_order_and_shares_endings(tmp_path):
    words = sorted({w.encode() for w in ["nation", "station", "ration", "ra", "rations", "stations", "a", "été"]})
    lexicon = B.compiled(words)
    assert B.found(lexicon, words).tolist() == list(range(len(words)))
    assert B.found(lexicon, [b"", b"nat", b"stationss", b"zz", b"x" * 500]).tolist() == [-1] * 5
    assert len(lexicon["final"]) < sum(map(len, words)) / 2
    B.save(f"{tmp_path}/f", lexicon, {"special": {}})
    back, meta = B.load(f"{tmp_path}/f")
    assert meta == {"special": {}} and all((back[k] == v).all() for k, v in lexicon.items())
    assert B.found(B.compiled([]), [b"a"]).tolist() == [-1]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert B.op2_bpe(spark, str(tmp_path)).count() == 0


def test_listed_pattern_agrees_with_the_general_one():
    rnd = random.Random(8)
    every = [chr(c) for c in range(0x250)]
    for c in every:
        for text in (c, f"a{c}b", f" {c}{c} 1", f"'{c}s ", f"  {c}"):
            assert B._LISTED(text) == B._ANY(text), repr(text)
    for _ in range(3000):
        text = "".join(rnd.choice(every + list("  'sntldvem\n\n ab1")) for _ in range(rnd.randint(1, 30)))
        assert B._LISTED(text) == B._ANY(text), repr(text)


def test_forgetting_words_changes_nothing(tmp_path, monkeypatch, library):
    monkeypatch.setattr(B, "HELD_WORDS", 5)
    arrays, meta = B.read_vocabulary(B.default_vocabulary())
    arrays |= {f"lex_{k}": v for k, v in B.compiled([b" a"]).items()} | {"ids": B.np.array([257], B.np.int32), "id_ends": B.np.array([1], B.np.int64)}
    B.save(f"{tmp_path}/f", arrays, meta)
    coder = B.Coder(f"{tmp_path}/f")
    rnd = random.Random(6)
    for _ in range(60):
        texts = [" ".join(rnd.choice(["a", "bc", "the", "zq", "42", "x'y", "tion"]) for _ in range(6)) for _ in range(3)]
        got = [B.np.frombuffer(x, B.np.int32).tolist() for x in coder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
