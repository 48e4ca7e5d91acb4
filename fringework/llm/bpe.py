"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

The words of the corpus are counted, and the most frequent ones are compiled with
their ids into a minimal acyclic automaton: common beginnings and endings share
states, and the numbers on a word's arcs add up to its place in the table of id
sequences. The automaton, that table and the merges go into one file that Spark
hands to every executor, where it is mapped into memory. A batch's new words walk
the automaton side by side; words that it lacks are merged exactly, pair by pair
in the order of their ranks.

Cases: a null text counts as empty and has no ids; a special token's string in a
text is that token, as in the library; very long words are merged with a heap.
Repeated rows are coded each, extra columns are ignored (or carried along where
asked), empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringework.llm.shared import free_names, given_back, shared_dir, table, text_or_empty, written

#: Fixed value: the pattern by which this family of vocabularies cuts text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words in the lexicon, and the longest one (bytes).
LEXICON_WORDS, LONGEST_WORD = 100_000, 48
#: Distinct words a counting task holds before it hands them on, and a coding worker before it starts afresh.
HELD_WORDS = 200_000
#: Rows handed on at a time.
ROWS_AT_ONCE = 256


@cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Above every packed rank.
_NONE = 1 << 60


class Merges:
    """Exact merging of one word."""

    def __init__(self, start: np.ndarray, merges: np.ndarray) -> None:
        self.start = start.tolist()
        self.rank = {(a, b): (i, c) for i, (a, b, c) in enumerate(merges.tolist())}
        # Rank and result in one number, so that the least of a list is the merge to make.
        self.packed = {a << 32 | b: i << 32 | c for i, (a, b, c) in enumerate(merges.tolist())}

    def ids(self, word: bytes) -> list[int]:
        ids = [self.start[b] for b in word]
        return self._short(ids) if len(ids) <= 64 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        look = self.packed.get
        ranks = [look(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = look(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = look(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(rank[p][0], i, *p, rank[p][1]) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j] = c, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := rank.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]


def compiled(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of the words: arcs as arrays.

    Words are added in order, and a finished tail is replaced by an equal state
    that stands already. ``key`` is state * 256 + byte, ascending; ``goal`` the
    state an arc leads to and ``add`` what it adds to a word's number.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settled(node: list) -> int:
        frozen = (node[0], tuple(sorted(node[1].items())))
        at = register.get(frozen)
        if at is None:
            at = register[frozen] = len(states)
            states.append(frozen)
        return at

    path: list[list] = [[False, {}]]
    last = b""
    for word in sorted(set(words)):
        same = len(os.path.commonprefix([last, word]))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = settled(node)
        for byte in word[same:]:
            path.append([False, {}])
            path[-2][1][byte] = -1
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = settled(node)
    root = settled(path[0])
    count = np.zeros(len(states), np.int64)
    key, goal, add = [], [], []
    for at, (final, arcs) in enumerate(states):  # goals stand before the states that lead to them
        n = int(final)
        for byte, to in arcs:
            key.append(at * 256 + byte)
            goal.append(to)
            add.append(n)
            n += count[to]
        count[at] = n
    return {
        "key": np.array(key, np.int64), "goal": np.array(goal, np.int32), "add": np.array(add, np.int32),
        "final": np.array([f for f, _ in states], np.uint8), "root": np.array([root], np.int64),
    }


def found(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Each word's number, or -1: all words walk the automaton side by side."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.full(len(words), -1, np.int64)
    if not len(lexicon["key"]) or not len(words):
        return out
    state = np.full(len(words), int(lexicon["root"][0]), np.int64)
    number = np.zeros(len(words), np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(lengths) - lengths
    alive = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_WORD))
    step = 0
    key, goal, add, final = lexicon["key"], lexicon["goal"], lexicon["add"], lexicon["final"]
    while len(alive):
        done = alive[lengths[alive] == step]
        out[done] = np.where(final[state[done]] == 1, number[done], -1)
        alive = alive[lengths[alive] > step]
        want = state[alive] * 256 + data[start[alive] + step]
        arc = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[arc] == want
        alive, arc = alive[hit], arc[hit]
        number[alive] += add[arc]
        state[alive] = goal[arc]
        step += 1
    return out


def save(path: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    """Arrays one after another behind a line that says where each begins, aligned so that they can be mapped."""
    at, where = 0, {}
    for name, a in arrays.items():
        where[name] = [at, str(a.dtype), list(a.shape)]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": where, "meta": meta}).encode()
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b"\0" * (-(8 + len(head)) % 64))
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + size].tobytes())
    base = 8 + size + -(8 + size) % 64
    out = {}
    for name, (at, kind, shape) in head["arrays"].items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = whole[base + at : base + at + n].view(kind).reshape(shape)
    return out, head["meta"]


def read_vocabulary(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Start ids of bytes, merges (left, right, result) in rank order, the bytes of each id, special tokens."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters, vocab = byte_letters(), told["model"]["vocab"]
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    start = np.zeros(256, np.int32)
    for letter, byte in letters.items():
        start[byte] = vocab[letter]
    pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in told["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)
    pieces = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, at in vocab.items():
        pieces[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    for token, at in special.items():
        pieces[at] = token.encode()
    ends = np.cumsum([len(p) for p in pieces])
    return {"start": start, "merges": merges, "piece_ends": ends.astype(np.int64), "pieces": np.frombuffer(b"".join(pieces), np.uint8)}, {"special": special}


#: The same pattern for texts below U+0250, where letters, digits and white space can be listed; such texts are most.
_LETTER, _DIGIT, _BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LISTED = re.compile(
    f" ?[{_LETTER}]++| ?[{_DIGIT}]++|'(?:s|t|re|ve|m|ll|d)| ?[^{_BLANK}{_LETTER}{_DIGIT}]++|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
).findall
_BEYOND = re.compile("[^\0-\u024f]").search
_ANY = regex.compile(PATTERN).findall


def words_of(text: str) -> list[str]:
    """The words that PATTERN cuts the text into."""
    return _ANY(text) if _BEYOND(text) else _LISTED(text)


def pieces_of(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """The bytes of each id."""
    ends, data = arrays["piece_ends"].tolist(), arrays["pieces"].tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _cutter(special: Iterable[str]):
    word = words_of
    if not special:
        return lambda text: [(None, word(text))]
    parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
    signs = sorted(special)

    def cut(text: str) -> list[tuple[str | None, list[str]]]:
        if not any(s in text for s in signs):
            return [(None, word(text))]
        pieces = parts(text)
        out = [(None, word(pieces[0]))]
        for token, rest in zip(pieces[1::2], pieces[2::2], strict=True):
            out += [(token, []), (None, word(rest))]
        return out

    return cut


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS, special: Iterable[str] = ()) -> DataFrame:
    """(word binary, n long): the most frequent words over all documents, at most ``most``; words of like counts go in or stay out together."""
    special = tuple(special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = _cutter(special), Counter()

        def told():
            pairs = [(w.encode("utf-8", "replace"), n) for w, n in seen.items() if len(w) <= LONGEST_WORD]
            pairs = [p for p in pairs if len(p[0]) <= LONGEST_WORD]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                for _, words in cut(t.as_py()):
                    seen.update(words)
                if len(seen) > HELD_WORDS:
                    yield told()
        yield told()
        given_back()

    counted = docs.select(text_or_empty(text).alias("t")).mapInArrow(count, "word binary, n long")
    totals = written(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word-counts")
    # So many classes of like counts; the word lists of tasks need not meet to find where to cut.
    like = F.floor(F.log2("n") * 64).cast("int")
    left, cut = most, None
    for r in sorted(totals.groupBy(like.alias("like")).count().collect(), key=lambda r: -r["like"]):
        left -= r["count"]
        if left < 0:
            break
        cut = r["like"]
    return totals.where(like >= cut) if cut is not None else totals.limit(0)


def lexicon_file(spark: SparkSession, vocabulary: str, words: list[bytes]) -> str:
    """Name of the file, compiled and handed to Spark, that every worker maps."""
    arrays, meta = read_vocabulary(vocabulary)
    merge = Merges(arrays["start"], arrays["merges"])
    automaton = compiled(words)
    listed = sorted(set(words))
    ids = [merge.ids(w) for w in listed]
    arrays |= {f"lex_{k}": v for k, v in automaton.items()}
    arrays["ids"] = np.array(list(chain.from_iterable(ids)), np.int32)
    arrays["id_ends"] = np.cumsum([len(x) for x in ids]).astype(np.int64) if ids else np.zeros(0, np.int64)
    name = hashlib.sha256(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())).hexdigest()[:20]
    name = f"lexicon-{name}.bin"
    with tempfile.TemporaryDirectory() as folder:  # on the driver, on its way to the shared folder
        save(f"{folder}/{name}", arrays, meta)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fringework/{name}")
        files = target.getFileSystem(conf)
        files.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{folder}/{name}"), target)
    spark.sparkContext.addFile(str(target.toString()))
    return name


class Coder:
    """Encodes and decodes with a mapped file.

    What it has looked up it keeps in two generations of ``HELD_WORDS``: words that
    come again stay, others go with the older one. Ids are packed 32-bit numbers.
    """

    def __init__(self, path: str) -> None:
        self.arrays, meta = load(path)
        self.special = {t: np.int32(i).tobytes() for t, i in meta["special"].items()}
        self.cut = _cutter(self.special)
        self.lexicon = {k[4:]: v for k, v in self.arrays.items() if k.startswith("lex_")}
        self.pieces = pieces_of(self.arrays)
        self.piece_objects = np.array(self.pieces, dtype=object)
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merged = 0

    @cached_property
    def merge(self) -> Merges:
        return Merges(self.arrays["start"], self.arrays["merges"])

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > HELD_WORDS:
            self.seen, self.older = {}, self.seen
        new = words - self.seen.keys()
        if self.older:
            again = new & self.older.keys()
            self.seen.update((w, self.older[w]) for w in again)
            new -= again
        new = list(new)
        raw = [w.encode("utf-8", "replace") for w in new]
        ends, ids = self.arrays["id_ends"], self.arrays["ids"]
        for word, data, at in zip(new, raw, found(self.lexicon, raw).tolist(), strict=True):
            if at >= 0:
                self.seen[word] = ids[ends[at - 1] if at else 0 : ends[at]].tobytes()
            else:
                self.merged += 1
                self.seen[word] = array("i", self.merge.ids(data)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        cut = [self.cut(t) for t in texts]
        every: set[str] = set()
        for parts in cut:
            for _, words in parts:
                every.update(words)
        self.learn(every)
        look = self.seen.__getitem__
        return [b"".join(chain.from_iterable((self.special[token],) if token is not None else map(look, words) for token, words in parts)) for parts in cut]

    def decode(self, packed: bytes) -> str:
        return b"".join(self.piece_objects[np.frombuffer(packed, np.int32)].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _coder(path: str) -> Coder:
    return Coder(path)


def coded(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = (), decode: bool = True) -> DataFrame:
    """key, columns in ``more``, token_ids array<int>, and decoded_text made from those ids; a name that stands in ``more`` gets a leading underscore."""
    held, *made = free_names([key, *more], "text", "token_ids", "decoded_text")
    inputs = docs.select(F.col(key), *more, text_or_empty(text).alias(held))
    outputs = inputs.drop(held).withColumn(made[0], F.array(F.lit(0)))
    if decode:
        outputs = outputs.withColumn(made[1], F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(SparkFiles.get(name))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids = coder.encode(batch.column(batch.num_columns - 1).to_pylist())
                flat = np.frombuffer(b"".join(ids), np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                names = [*batch.schema.names[:-1], made[0]]
                if decode:
                    columns.append(pa.array(map(coder.decode, ids), pa.string()))
                    names.append(made[1])
                yield pa.RecordBatch.from_arrays(columns, names=names)
        given_back()

    return inputs.mapInArrow(run, outputs.schema)


def prepared(docs: DataFrame, vocabulary: str | None = None, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Counts words over all of ``docs``, compiles the lexicon and returns the name of its file."""
    vocabulary = vocabulary or default_vocabulary()
    special = read_vocabulary(vocabulary)[1]["special"]
    words = [bytes(r["word"]) for r in frequent_words(docs, text, most, special).collect()]
    return lexicon_file(docs.sparkSession, vocabulary, words)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digested(rows: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded text."""
    joined = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return (
        rows.withColumn("n_tokens", F.size("token_ids").cast("long"))
        .withColumn("ids_sha256", F.sha2(joined, 256))
        .withColumn("decoded_sha256", F.sha2("decoded_text", 256))
        .drop("token_ids", "decoded_text")
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digested(coded(docs, prepared(docs)))


QUERIES = {"op2_bpe": op2_bpe}
#: BPE has no SQL; the tests compare with the tokenizers library.
ORACLE_SQL: dict[str, str] = {}
