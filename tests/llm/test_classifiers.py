import random

import pytest

from tidemark.llm import labelled, quality, toxicity

WORDS = "river stone lamp green walk quiet paper cloud seven market window garden silver table morning letter".split()


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ly", "er"]) for _ in range(rnd.randint(20, 200))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for w in rnd.sample(["grobian", "vermin", "blockhead"], 2):
                words.insert(rnd.randrange(len(words)), w)
        if bad:
            words = [w.upper() + "!!" if rnd.random() < 0.9 else "$$$" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def accuracy(result, truth, held):
    rows = [r for r in result.collect() if r.held_out == held]
    return sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows)


@pytest.mark.parametrize("module, column", [(toxicity.op1, 2), (quality.op7, 1)])
def test_held_out_accuracy(docs, labels, module, column):
    d, y = corpus()
    out = module(docs(d), labels(y))
    assert accuracy(out, {r[0]: r[column] for r in y}, True) > 0.95
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]


def test_folding_and_lexicon():
    assert toxicity.fold_words("1D10T ｍoron $cum Ѕtupid v\u200bermin") == ["ldlot", "moron", "scum", "stupld", "vermln"]
    lexicon = toxicity.Lexicon({" moron ": 2.0, " vequ": 3.0}, ["white trash"])
    assert sum(lexicon.hits("a moron moron vequta vequ oxymoron".split()).values()) == 7.0
    covered = toxicity.Lexicon({" trash ": 2.0}, ["white trash"])
    assert covered.hits("white trash".split()) == {} and len(covered.hits("white trash trash".split())) == 1
    assert toxicity.Lexicon({}).hits(["a"]) == {}


def naive_hits(words, entries, phrases):
    """Every word with its best entry, word by word, without those in an exception phrase."""
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    found = {}
    for start, word in zip(starts, words, strict=True):
        fits = [w for e, w in entries.items() if (e.endswith(" ") and e[1:-1] == word) or (not e.endswith(" ") and word.startswith(e[1:]) and len(word) > len(e) - 1)]
        if fits:
            found[start] = max(fits)
    for i in range(len(words)):
        for phrase in phrases:
            own = phrase.split()
            if words[i : i + len(own)] == own:
                for k in range(i, i + len(own)):
                    found.pop(starts[k], None)
    return found


def test_automaton_equals_naive_matching():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5)))
    for _ in range(300):
        entries = {f" {word()}{rnd.choice(['', ' '])}": float(rnd.randint(1, 5)) for _ in range(rnd.randint(0, 8))}
        phrases = {" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 4))}
        lexicon = toxicity.Lexicon(entries, phrases)
        for _ in range(5):
            words = [word() for _ in range(rnd.randint(0, 12))]
            assert lexicon.hits(words) == naive_hits(words, entries, phrases), (entries, phrases, words)


def test_sizes_equal_a_recomputation():
    """Compressed sizes piece by piece with the library's plain calls; the difference alone tells good from bad."""
    import zstandard

    rnd = random.Random(6)
    make = lambda bad: " ".join(rnd.choice(WORDS).upper() + "!!" if bad else rnd.choice(WORDS) for _ in range(rnd.randint(1, 400)))
    good, bad = ([make(b) for _ in range(60)] for b in (False, True))
    books = [quality.train_dictionary([p for t in texts for p in quality.pieces_of(t)]) for texts in (good, bad)]
    features = quality.feature_maker(*books)
    texts = [*good[:20], *bad[:20], "", None, "é" * 700]
    want = []
    for text in texts:
        data = (text or "").encode()
        parts = [data[i : i + 512] for i in range(0, len(data), 512)] or [b""]
        sizes = []
        for book in books:
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(book), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(p)) for p in parts))
        want.append((sizes[1] - sizes[0]) / sum(sizes))
    got = features(texts)[:, 0]
    assert abs(got - want).max() < 0.02  # the library may choose other parameters for a small piece with a prepared dictionary
    assert min(got[:20]) > max(got[20:40])
    assert b"".join(quality.pieces_of("é" * 700)) == ("é" * 700).encode() and quality.pieces_of(None) == [b""]


def test_repeated_and_contradictory_labels(spark, docs, labels):
    """A repeated id counts once in the sample, one with both labels not at all."""
    d, y = corpus(n=60)
    rows = labelled.sample(docs([*d, *[(1, "one word")] * 50]), labels([*y, *[(1, 1, 0)] * 50, (2, 1, 1), (2, 1, 0)]), "toxic", toxicity.held, 1000)
    assert rows.count() == sum(1 for i, _ in d if not labelled_out(i) and i != 2)


def test_obfuscated_words_are_caught(docs, labels):
    d, y = corpus()
    d += [(1000, "river stone gr0bian lamp v3rmin walk"), (1001, "river stone lamp walk"), (1002, "the grоbian walks")]
    found = {r.doc_id: r.predicted for r in toxicity.op1(docs(d), labels(y)).collect()}
    assert (found[1000], found[1001], found[1002]) == (1, 0, 1)


@pytest.mark.parametrize("module", [toxicity.op1, quality.op7])
def test_odd_rows(docs, labels, module):
    d, y = corpus(n=120)
    d += [(None, "x"), (500, None), (501, ""), (502, "word " * 200_000), (502, "word " * 3), (502, "word " * 3)]
    y += [(None, 1, 1), (500, None, None), (999, 1, 1)]
    out = {}
    for r in module(docs(d), labels(y)).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert len(out[502]) == 3 and out[500][0].score == out[501][0].score and all(0 <= r.score <= 1 for v in out.values() for r in v)
    assert out[None][0].held_out is False


@pytest.mark.parametrize("module", [toxicity.op1, quality.op7])
def test_empty_and_one_class(docs, labels, module):
    assert module(docs([]), labels([])).count() == 0
    d, _ = corpus(n=20)
    one = module(docs(d), labels([(i, 1, 0) for i, _ in d])).collect()
    assert len(one) == 20 and all(0 <= r.score <= 1 for r in one)
    assert module(docs(d), labels([])).count() == 20


def test_labels_held_out_are_not_used(docs, labels):
    d, y = corpus()
    flipped = [(i, q, 1 - t) if labelled_out(i) else (i, q, t) for i, q, t in y]
    a, b = (sorted(tuple(r) for r in toxicity.op1(docs(d), labels(z)).collect()) for z in (y, flipped))
    assert a == b


def labelled_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_filters_keep_columns(docs, labels):
    d, y = corpus()
    frame = docs(d)
    kept = toxicity.drop_toxic(frame, labels(y))
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _, t in y if not t}
    good = quality.keep_good(frame, labels(y))
    assert good.columns == frame.columns and abs(good.count() - sum(q for _, q, _ in y)) <= 8


def test_logistic_calibration():
    import numpy as np

    x = np.array([[0.0], [0.1], [0.9], [1.0]] * 20)
    model = labelled.fit_logistic(x, (x[:, 0] > 0.5).astype(float))
    p = labelled.logistic(model, np.array([[0.0], [1.0]]))
    assert p[0] < 0.2 and p[1] > 0.8
