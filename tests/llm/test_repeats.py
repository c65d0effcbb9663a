"""Repeated word sequences against all windows of all documents."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import repeats


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def expected(rows, length=13):
    """(doc_id, n_words, n_removed, hash) of every row, sorted."""
    least = {}
    texts = [(i, words_of(t)) for i, t, *_ in rows]
    for i, w in texts:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in texts:
        gone = {j for k in range(len(w) - length + 1) if i is not None and least[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(rnd, n, vocabulary, passages, ids):
    rows = []
    for _ in range(n):
        words = []
        while rnd.random() < 0.8 and len(words) < 200:
            passage = rnd.choice(passages)
            begin = rnd.randint(0, len(passage) - 1)
            words += rnd.choices(vocabulary, k=rnd.randint(0, 30)) if rnd.random() < 0.5 else passage[begin : begin + rnd.randint(1, 60)]
        rows.append((ids(), rnd.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, share", [(1, None), (2, 0), (3, None)])
def test_equals_all_windows(docs, monkeypatch, seed, share):
    if share is not None:
        monkeypatch.setattr(repeats, "HOT_SHARE", 10**9)
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5 if seed == 1 else 400)] + ["é", "　x", "A", "a"]
    passages = [rnd.choices(vocabulary, k=rnd.randint(13, 120)) for _ in range(8)]
    rows = random_rows(rnd, 200, vocabulary, passages, lambda: rnd.choice([None, *range(-30, 90)]))
    rows += [(5, None), (6, ""), (7, " \n "), (8, "one two")] + [(300 + k, " ".join(passages[0])) for k in range(40)] + [(300, " ".join(passages[0]))]
    assert found(repeats.op11(docs(rows))) == expected(rows)


@pytest.mark.parametrize("length, gram", [(1, 1), (4, 4), (13, 1), (13, 13), (50, 5)])
def test_other_lengths(docs, length, gram):
    rnd = random.Random(length)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [rnd.choices(vocabulary, k=90) for _ in range(4)]
    counter = iter(range(1000))
    rows = random_rows(rnd, 60, vocabulary, passages, lambda: next(counter))
    got = [(r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), hashlib.sha256(r.text).hexdigest()) for r in repeats.find_repeats(docs(rows), length, gram).collect()]
    assert sorted(got, key=str) == expected(rows, length)


def test_most_documents_hold_one_passage(docs, monkeypatch):
    """Frequent anchors are dealt out over many tasks; a passage inside different neighbours, and groups of exact copies."""
    monkeypatch.setattr(repeats, "SAMPLE_ROWS", 100)
    rnd = random.Random(9)
    passage, copy = ([f"{c}{k}" for k in range(n)] for c, n in (("p", 60), ("c", 40)))
    own = lambda i: [f"d{i}x{rnd.random()}" for _ in range(rnd.randint(0, 20))]
    rows = [(i, " ".join([*own(i), *(passage if i % 3 == 0 else copy if i % 3 == 1 else []), *own(i)])) for i in range(600)]
    rows += [(i, " ".join(passage)) for i in range(1000, 1400)]
    got = found(repeats.op11(docs(rows)))
    assert got == expected(rows) and sum(r[2] for r in got) == 60 * (199 + 400) + 40 * 199


def test_spans_are_maximal(docs):
    passage = [f"p{k}" for k in range(40)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x", *passage[:30], "y", *passage[10:40], "z"])), (3, " ".join([*passage[:20], *passage[20:40]]))]
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in repeats.find_repeats(docs(rows)).collect()}
    assert spans == {1: [], 2: [(1, 31), (32, 62)], 3: [(0, 40)]}
    assert {r.doc_id: r.text for r in repeats.remove_repeats(docs(rows)).collect()} == {1: " ".join(passage), 2: "x y z", 3: ""}


def test_equal_windows_select_equal_anchors():
    rnd = random.Random(4)
    for length, gram in ((13, 5), (13, 13), (6, 1)):
        texts = [[b"w%d" % rnd.randint(0, 3) for _ in range(rnd.randint(0, 60))] for _ in range(40)]
        text, place, windows, anchor, _ = repeats.seeds(texts, length, gram)
        of_window = {}
        held = set()
        for t, p, n, a in zip(text.tolist(), place.tolist(), windows.tolist(), anchor.tolist(), strict=True):
            for k in range(p, p + n):
                assert of_window.setdefault(tuple(texts[t][k : k + length]), a) == a
                held.add((t, k))
        assert held == {(t, k) for t, w in enumerate(texts) for k in range(len(w) - length + 1)}  # each window has one anchor


def test_hashes_tell_order_and_place_apart():
    words = repeats.hashed([[b"a", b"b", b"a", b"b", b"b", b"a"]])
    begin, end = np.array([0, 2, 1, 4, 0]), np.array([2, 4, 3, 6, 3])
    ab, ab2, ba, ba2, aba = repeats.sequences(words[:, 0], begin, end, 0).tolist()
    assert ab == ab2 and ba == ba2 and len({ab, ba, aba}) == 3


def test_empty_table_and_bad_settings(docs):
    assert repeats.op11(docs([])).count() == 0
    with pytest.raises(ValueError, match="gram"):
        repeats.find_repeats(docs([]), 4, 5)
