import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import DATA

from rootline.llm import leakage
from rootline.llm.notebooks import read, seen
from rootline.session import table

CELL = "array<struct<cell_type:string,exec_count:int,mime:string,n_chars:bigint>>"
SCHEMA = f"doc_id long, text string, nb_format string, cells {CELL}"
P = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
WORDS = P.split()


def notebook(*sources, outputs=()):
    return json.dumps({"cells": [{"cell_type": "markdown", "source": s} for s in sources] + [{"cell_type": "code", "source": "x", "outputs": [o]} for o in outputs]})


def test_md():
    text = "# T\n\nFirst.\n\nSecond.\n\n```python\na\n\nb\n```\n\n```\nout\n```\n\n![png](data:image/png;base64,AAAA)\n\n<table><tr><td>x</td></tr></table>\n"
    cells = [("text", 11), ("text", 7), ("code", 4), ("output", 3), ("output", 9), ("output", 34)]
    assert [(k, c.strip()) for k, c in read(text, "md", cells)] == [("text", "# T\n\nFirst."), ("text", "Second."), ("code", "a\n\nb"), ("output", "out"), ("output", ""), ("output", "x")]
    assert [k for k, _ in read(text, "md")] == ["text", "text", "code", "output", "text", "text"]


def test_percent_and_console():
    text = "# %% [1]\r\nx = 1\r\n\r\n#> out\r\n#> more\r\n\r\n# %% [markdown]\r\n# # T\r\n# \r\n# words"
    assert read(text, "percent") == [("code", "x = 1"), ("output", "out\nmore"), ("text", "# T\n\nwords")]
    text = "In [1]: a\n   ...: b\n\nOut[1]:\nx\n\ny\n\nwords here"
    assert read(text, "console", [("code", 3), ("output", 4), ("text", 10)]) == [("code", "a\nb"), ("output", "x\n\ny"), ("text", "words here")]


def test_ipynb_and_cuts():
    text = notebook("abé", ["c\n", "d"], outputs=[{"traceback": ["\x1b[0;31mErr\x1b[0m: x"]}])
    assert read(text, "ipynb") == [("text", "abé"), ("text", "c\nd"), ("code", "x"), ("output", "Err: x")]
    for cut in range(1, len(text)):
        read(text[:cut], "ipynb")
    assert read(text[: text.index("\\u00e9") + 3], "ipynb") == [("text", "ab")]
    assert read(text[: text.index('"d"') + 2], "ipynb")[1] == ("text", "c\nd")
    assert read("not json at all", "ipynb") == [("text", "not json at all")]
    assert read(None, "md") == read("", "ipynb") == []
    assert read("x", None) == [("text", "x")]


def test_markup():
    assert seen("text", "x<y and y>z <b>bo</b>ld a<br/>b [link text](http://a.b/c_d) &eacute; <b and c>") == "x<y and y>z bold a b link text é <b and c>"
    assert seen("output", '<table class="x"><tr><td>a</td><td>b &amp; c</td></tr></table> <Figure size 640x480>').split() == "a b & c <Figure size 640x480>".split()
    assert seen("code", "a = '<b>&amp;</b>'") == "a = '<b>&amp;</b>'"


def leaked(spark, docs, items, **more):
    rows = [(i, t, f, [("text", None, None, n) for n in c]) for i, (t, f, c) in enumerate(docs)]
    found = leakage.leaked(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), **more)
    return {(r.item_id, r.doc_id) for r in found.collect()}


def test_passages(spark):
    items = [(1, f"Intro. {P.upper()}! tail"), (2, P), (3, " ".join(WORDS[:11])), (4, None), (5, "x y " + " ".join(WORDS[::-1]))]
    docs = [
        (f"some {P.replace(' ', ', ')} more", "md", [200]),
        ("# %% [markdown]\n# " + "\n# ".join(WORDS), "percent", []),
        (notebook("aa " + P.title()), "ipynb", []),
        (" ".join(WORDS[:6]) + "\n\n" + " ".join(WORDS[6:]), "md", [len(" ".join(WORDS[:6])), len(" ".join(WORDS[6:]))]),
        (P.replace("zeta", "zeta odd"), "md", []),
        (None, "md", []),
        ("", "md", []),
        (" ".join(WORDS[:11]), "md", []),
        (f"{P} {P}", "md", []),
        (notebook("x", outputs=[{"data": {"text/html": "<p>" + "</p><p>".join(WORDS) + "</p>"}}]), "ipynb", []),
    ]
    expected = {(i, d) for i in (1, 2) for d in (0, 1, 2, 8, 9)}
    assert leaked(spark, docs, items) == expected
    assert leaked(spark, docs, items, block_words=13) == expected


def test_common_words_and_repeats(spark):
    same = " ".join(["the"] * 40)
    assert leaked(spark, [(same, "md", []), (" ".join(["the"] * 11), "md", [])], [(1, same), (1, same), (2, "the " * 12)]) == {(1, 0), (2, 0)}


def test_positions_and_lengths(spark):
    docs = spark.createDataFrame([(7, f"one two {P} three", "md", None)], SCHEMA)
    items = spark.createDataFrame([(1, f"zero {P} nine", "x")], "item_id long, text string, doc_id string")
    r = leakage.matches(docs, items).first()
    assert (r.cell, r.start, r.item_start, r.words) == (0, 2, 1, 12)


def test_proximity(spark):
    near = " ".join(w if i not in (3, 8) else "odd" for i, w in enumerate(WORDS))
    loose = " ".join(w + (" x y" if i == 5 else "") for i, w in enumerate(WORDS))
    far = " ".join(w + " x y" for w in WORDS)
    few = " ".join(w if i % 3 else "odd" for i, w in enumerate(WORDS))
    docs = spark.createDataFrame([(i, t, "md", None) for i, t in enumerate([P, near, loose, far, few, ""])], SCHEMA)
    items = spark.createDataFrame([(1, P), (2, "short"), (3, None)], "item_id long, text string")
    assert {tuple(r) for r in leakage.proximity(docs, items).collect()} == {(1, 0, 12), (1, 1, 10), (1, 2, 12)}
    assert leakage.proximity(docs, items.limit(0)).count() == 0


def test_proximity_against_brute_force(spark):
    """Any alignment counts, whichever word is looked up first."""
    rng = np.random.default_rng(9)
    words = ["w%d" % i for i in range(14)]
    items = [(i, list(rng.choice(words, 9))) for i in range(4)]
    docs = []
    for _ in range(16):
        text = list(items[rng.integers(4)][1])
        for _ in range(rng.integers(1, 4)):
            text.insert(int(rng.integers(len(text))), "odd") if rng.random() < 0.6 else text.pop(int(rng.integers(len(text))))
        docs.append(list(rng.choice(words, 6)) + text)
    expected = {}
    for i, w in items:
        for d, c in enumerate(docs):
            for k in range(len(w) - 5):
                for shift in range(-12, len(c) + 12):
                    n = sum(any(0 <= shift + j + s < len(c) and c[shift + j + s] == w[k + j] for s in (-1, 0, 1)) for j in range(6))
                    if n >= 5:
                        expected[i, d] = max(n, expected.get((i, d), 0))
    got = leakage.proximity(spark.createDataFrame([(d, " ".join(c), "md", None) for d, c in enumerate(docs)], SCHEMA), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), 6, 5, 1)
    assert {(r.item_id, r.doc_id): r.terms for r in got.collect()} == expected and expected


def test_one_index_for_all_test_sets(spark):
    """The index is made before any item is known; small shards, blocks and pieces change nothing."""
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(30)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    docs = [(f"{t}\n\n{' '.join(reversed(t.split()))}", "md", []) for t in texts] + [(" ".join(["w1"] * 50), "md", [])]
    items = [(i, " ".join(t.split()[k : k + 25])) for i, (t, k) in enumerate((t, k) for t in texts[:4] for k in (0, 17, 35))] + [(99, "w1 " * 13)]
    table_of = spark.createDataFrame([(i, t, f, None) for i, (t, f, _) in enumerate(docs)], SCHEMA)
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, text in items:
        w = text.split()
        grams = {tuple(w[k : k + 6]) for k in range(len(w) - 5)}
        for d, (t, _, _) in enumerate(docs):
            for cell in t.split("\n\n"):
                c = cell.split()
                expected |= {(i, d) for k in range(len(c) - 5) if tuple(c[k : k + 6]) in grams}
    for shard_words in (1, 200, 10**6):
        index = leakage.build(table_of, shard_words)
        for block in (10, 10**6):
            assert {(r.item_id, r.doc_id) for r in leakage.matches_in(index, asked, 6, block).collect()} == expected
    longest = {(r.item_id, r.doc_id): r.words for r in leakage.matches_in(index, asked, 6).orderBy("words").collect()}
    assert longest[0, 0] == 25 and longest[99, 12] == 13
    assert leakage.proximity_in(index, asked, 6, 6, 0).select("item_id", "doc_id").count() == len(expected)


def test_empty(spark):
    assert leaked(spark, [], [(1, P)]) == set()
    assert leaked(spark, [(P, "md", [])], []) == set()


def test_very_long_text(spark):
    assert leaked(spark, [("filler " * 300_000 + P, "md", [])], [(1, P)]) == {(1, 0)}


def test_against_brute_force(spark):
    items = pq.read_table(f"{DATA}/eval_items.parquet").to_pylist()
    grams = {}
    for it in items:
        w = leakage.words_of(it["text"])
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(it["item_id"])
    expected = set()
    for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist():
        for _, content in read(r["text"], r["nb_format"], [(c["cell_type"], c["n_chars"]) for c in r["cells"] or []]):
            w = leakage.words_of(content)
            for i in range(len(w) - 11):
                expected |= {(x, r["doc_id"]) for x in grams.get(tuple(w[i : i + 12]), ())}
    got = leakage.leaked(table(spark, DATA, "documents"), table(spark, DATA, "eval_items"))
    assert {(r.item_id, r.doc_id) for r in got.collect()} == expected
    assert expected


@pytest.mark.parametrize("form", ["md", "percent", "console", "ipynb"])
def test_listed_cells_are_found(form):
    rows = [r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist() if r["nb_format"] == form and r["text"]]
    for r in rows:
        listed = [c["cell_type"] for c in r["cells"]]
        got = [k for k, _ in read(r["text"], form, [(c["cell_type"], c["n_chars"]) for c in r["cells"]])]
        if form != "ipynb":  # there an output without code comes with an empty code cell
            assert sorted(got) == sorted(listed[: len(got)]), r["doc_id"]
