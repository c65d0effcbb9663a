import hashlib
import random

import pytest

from tidemark.llm import bpe, token_counts
from tidemark.llm.common import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "abcdeiou stnr'’éßΣσςİıǅ１²½٣中文字😀\u0301\x1c\x85\u3000\u2028 \n\t.,!?<|>#"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokenizer_path(bpe.MODEL))
    t.no_truncation()
    t.no_padding()
    return t


def sample_texts(spark, sf):
    rnd = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    return texts + ["", "<|endoftext|> hi <|startoftext|>", "don't I'LL 're", "aaaa" * 500, "日本語" * 300, "x" * 5000]


def test_encoding_equals_the_library(spark, sf, docs, library):
    texts = sample_texts(spark, sf)
    got = {r.doc_id: r for r in bpe.encode_documents(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i].ids == ids and got[i].n_tokens == len(ids), repr(text[:50])
        assert got[i].ids_sha256 == digest(" ".join(map(str, ids))) and got[i].decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


def test_odd_rows(docs):
    rows = bpe.op4(docs([(1, None), (1, None), (None, "a"), (2, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 0), (1, 0), (2, 0)]
    assert bpe.op4(docs([])).count() == 0 and token_counts.op9(docs([])).count() == 0


def test_other_settings_are_refused(tmp_path):
    import json

    with open(tokenizer_path(bpe.MODEL), encoding="utf-8") as file:
        data = json.load(file)
    changes = [("normalizer", {"type": "NFD"}), ("pre_tokenizer", None), ("post_processor", {"type": "x"}), ("decoder", {"type": "BPEDecoder"}), ("new", 1), ("model", data["model"] | {"ignore_merges": True}), ("model", data["model"] | {"new": 1})]
    for key, value in changes:
        (tmp_path / "t.json").write_text(json.dumps(data | {key: value}))
        with pytest.raises(ValueError, match="settings"):
            bpe.load(str(tmp_path / "t.json"))


def test_long_words_by_the_same_tables(library):
    rnd = random.Random(3)
    automaton = bpe.load(tokenizer_path(bpe.MODEL))
    words = ["".join(rnd.choice("etaoinshrdlué") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for word in words:
        symbols = bytes(word.encode())
        assert automaton._encode_long(symbols) == automaton.encode_many([symbols])[1].tolist() == library.encode(word, add_special_tokens=False).ids
    counts, ids = automaton.encode_many([w.encode() for w in words] + [b"", words[0].encode() * 9])
    assert counts[300] == 0 and ids[-counts[301] :].tolist() == library.encode(words[0] * 9, add_special_tokens=False).ids


def merged(word, merges):
    parts = [*word[:-1], word[-1] + bpe.WORD_END]
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def test_automaton_on_random_merges():
    rnd = random.Random(8)
    for _ in range(200):
        symbols = ["a", "b", "a</w>", "b</w>"]
        merges = []
        for _ in range(rnd.randint(1, 12)):
            a, b = rnd.choice([s for s in symbols if not s.endswith("</w>")]), rnd.choice(symbols)
            if a + b not in symbols:
                symbols.append(a + b)
                merges.append((a, b))
        automaton = bpe.Automaton({s: i for i, s in enumerate(symbols)}, merges)
        for _ in range(30):
            word = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60)))
            assert [automaton.labels[i] for i in automaton.encode(word)] == merged(word, merges), (merges, word)


def greedy(word, begin, carry_on):
    at = count = 0
    while at < len(word):
        pool = carry_on if at else begin
        for end in range(len(word), at, -1):
            if word[at:end] in pool:
                break
        else:
            return token_counts.UNKNOWN
        at, count = end, count + 1
    return count


def test_longest_match_on_random_vocabularies():
    rnd = random.Random(9)
    for _ in range(500):
        pieces = lambda: {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 10))}
        begin, carry_on = pieces(), pieces()
        matcher = token_counts.LongestMatch(begin, carry_on)
        for _ in range(10):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
            assert matcher.count(word) == greedy(word, begin, carry_on)


def test_token_counts_of_documents(spark, sf, docs):
    pieces = set(token_counts.load_pieces(tokenizer_path(bpe.MODEL)))
    texts = sample_texts(spark, sf)[:60] + [None]
    for r in token_counts.op9(docs(list(enumerate(texts)))).collect():
        words = bpe.word_pattern().findall(bpe.normalise(texts[r.doc_id] or ""))
        symbols = bpe.byte_symbols()
        counts = [greedy("".join(symbols[b] for b in w.encode()), pieces, pieces) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(counts), 0)


def test_unknown_words(docs):
    row = token_counts.token_counts(docs([(1, "ab ac zz")]), ["a", "b"], ["b"]).first()
    assert (row.n_words, row.n_tokens, row.n_unknown) == (3, 4, 2)
