from fringework.llm import licenses as L

MIT = dict(L.KNOWN)["MIT"]
TEXTS = {i: t for i, t in L.KNOWN}


def scan(spark, rows):
    return {r[0]: tuple(r)[2:] for r in L.scanned(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string")).collect()}


def test_variants_of_whole_texts(spark):
    isc = next(t for i, t in L.KNOWN if i == "ISC")
    varied = "Copyright (c) 2019, Someone <a@b.c>\nAll rights reserved.\n\n" + isc.upper().replace("\n\n", "\n \n").replace('"AS IS"', "“AS IS”")
    bsd = next(t for i, t in L.KNOWN if i == "BSD-2-Clause").replace("1. ", "  * ").replace("2. ", "- ").replace("HOLDER ", "OWNER ").replace("HOLDERS", "OWNERS")
    got = scan(spark, [
        (1, varied), (2, bsd), (3, isc + " extra"), (4, None), (5, ""), (6, "...\n--"), (7, "x\n  released UNDER the MIT licence\nLicensed under CC BY-NC 4.0\nlicensed under cc by-nc 4.0!"),
        (8, "prose with Released under the MIT License. inside"), (9, "plain " * 50_000), (None, "Released under the MIT License."),
    ])
    assert got[1] == ("ISC", 0, None) and got[2][0] == "BSD-2-Clause" and got[3][0] is None
    assert got[4] == got[5] == got[6] == (None, 0, None)
    assert got[7] == (None, 3, "CC-BY-NC-4.0,MIT") and got[8] == (None, 0, None) and got[9] == (None, 0, None)
    assert got[None] == ("MIT", 1, "MIT")


def test_repeated_keys_keep_their_own_rows(spark):
    rows = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (1, "other"), (1, "other")], "doc_id long, text string")
    assert sorted(r.n_license_lines for r in L.scanned(rows).collect()) == [0, 0, 1]
    assert L.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_kind_of_copyright_line(spark):
    marks = ["Copyright Jane Doe", "(c) Jane Doe", "Copyright Jane Doe 2019", "Copyright (C) 2001-2004 by J. Doe <j@d.org>", "© 2020 Jane", "   // Copyright: The Foo Authors", "Portions Copyright 1999 X",
             "copyright 2010 the people", "Copr. 1988 Someone", "All rights reserved.", "COPYRIGHT <YEAR> <OWNER>"]
    isc = next(t for i, t in L.KNOWN if i == "ISC")
    rows = [(i, f"{m}\n\n{isc}") for i, m in enumerate(marks)]
    # Lines of a licence that begin with the word stay.
    wrapped = "copyright notice and this permission"
    rows += [(100, isc.replace(wrapped, "\n" + wrapped)), (101, isc.replace(wrapped, "")), (102, "Jane Doe\n" + isc)]
    got = scan(spark, rows)
    assert [i for i in range(len(marks)) if got[i][0] != "ISC"] == [] and got[100][0] == "ISC" and got[101][0] is got[102][0] is None


def test_spellings_are_whole_words(spark):
    same = [("the licence of the programme", "The License of the program"), ("sub-licence\nfoo", "sublicense foo"), ("per cent", "percent"), ("favourite licences", "favorite licenses"), ("non\ncommercial", "noncommercial")]
    other = [("programmer", "programr"), ("favours", "favors and")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(t for pair in same + other for t in pair)], "doc_id long, text string")
    d = {r.doc_id: r.digest for r in L.scanned(rows).collect()}
    assert all(d[2 * i] == d[2 * i + 1] for i in range(len(same))) and all(d[2 * i] != d[2 * i + 1] for i in range(len(same), len(same) + len(other)))


def plain(text):
    """The canonical form, word by word and line by line."""
    import re

    out = []
    for line in (text or "").split("\n"):
        if re.search(L._COPYRIGHT, line) and not re.search(L._SENTENCE, line) or re.search(L._RESERVED, line):
            continue
        line = re.sub(r"^[ \t]*(?:[0-9]{1,2}|[a-z])[.)][ \t]", " ", line.lower())
        out.append("".join(c if c.isalpha() or c.isnumeric() else " " for c in line).split())
    one = lambda words: " ".join(words)

    def spelt(s):
        for a, b in L.EQUIVALENT:
            words, made, n = s.split(), [], len(a.split())
            while words:
                if words[:n] == a.split():
                    made, words = made + b.split(), words[n:]
                else:
                    made, words = made + words[:1], words[1:]
            s = one(made)
        return s

    return spelt(one(w for line in out for w in line)), [spelt(one(x)) for x in out]


def test_against_a_plain_scan(spark):
    import random

    rnd = random.Random(9)
    known = {}
    for i, t in sorted(L.KNOWN):
        known.setdefault(plain(t)[0], i)
    notices = [t for _, t in L.KNOWN]
    rows = []
    for i in range(150):
        lines = [" ".join(rnd.choice(["licence", "the", "programme", "sub", "license", "per", "cent", "a.", "1)", "Straße", "(c)", "x_y"]) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(5))]
        lines += rnd.sample(notices, rnd.randrange(3))
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines) if i % 10 else rnd.choice(notices).upper()))
    got = {r.doc_id: r for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import hashlib

    for i, t in rows:
        whole, lines = plain(t)
        hits = [known[x] for x in lines if x in known]
        want = (hashlib.sha256(whole.encode()).hexdigest() if whole else None, known.get(whole), len(hits), ",".join(sorted(set(hits))) or None)
        assert (got[i].digest, got[i].license_id, got[i].n_license_lines, got[i].line_licenses) == want, t


def test_a_table_of_known_texts_and_string_keys(spark):
    known = spark.createDataFrame([("Z", "Do as you like."), ("A", "do as YOU like"), ("N", None)], "license_id string, text string")
    got = {r.doc_id: r.license_id for r in L.scanned(spark.createDataFrame([("k", "Do as you\nlike!", 1), (None, "no", 2)], "doc_id string, text string, _row int"), known).collect()}
    assert got == {"k": "A", None: None}
