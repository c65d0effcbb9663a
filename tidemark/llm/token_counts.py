"""Token counts by linear longest match, without building pieces.

The vocabulary's pieces form a trie with one root for pieces that begin a word and one for pieces that continue it. Every node has a failure link and the number of pieces that are final once the match
fails there; both are computed breadth first from the parent's. A word is then read once: each character either goes down
the trie or follows failure links, adding their numbers, and each link followed is paid for by a character read, so time
is linear in the word. The result is the number of pieces of greedy longest-match-first splitting. A word that cannot be
split into pieces counts as one unknown token.

The query takes its vocabulary from ``word_bpe_49k.json``: each token's string, without the mark of word ends, may begin and
may continue a word; texts are normalised and split as that file says, over the byte-level alphabet, so no word is unknown.
Null and empty texts: no words, no tokens. Repeated rows give repeated results, an empty table an empty one. Only doc_id
and text are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import MODEL, WORD_END, byte_symbols, normalise, split_words
from tidemark.llm.common import map_batches, tokenizer_path

CONTINUES = "##"
UNKNOWN = -1
#: A task remembers words of up to ``SHORT`` characters, twice ``REMEMBERED`` at most: a full memory becomes the old one, and
#: what is asked for again moves from there to the new one.
REMEMBERED, SHORT = 150_000, 64


class LongestMatch:
    """The trie with failure links and popped-piece counts; nodes are numbers, 0 and 1 the two roots."""

    def __init__(self, begin: Iterable[str], carry_on: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        whole: set[int] = set()
        for root, piece in [(0, p) for p in begin if p] + [(1, p) for p in carry_on if p]:
            node = root
            for c in piece:
                below = self.children[node]
                if c not in below:
                    below[c] = len(self.children)
                    self.children.append({})
                node = below[c]
            whole.add(node)
        self.link: list[int | None] = [None] * len(self.children)
        self.pops = [0] * len(self.children)
        level = [0, 1]
        while level:
            following = []
            for parent in level:
                for c, node in self.children[parent].items():
                    following.append(node)
                    if node in whole:
                        self.link[node], self.pops[node] = 1, 1
                        continue
                    at, popped = self.link[parent], self.pops[parent]
                    while at is not None and c not in self.children[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at is not None:
                        self.link[node], self.pops[node] = self.children[at][c], popped
            level = following

    def count(self, word: str) -> int:
        """Pieces of the word; ``UNKNOWN`` if it cannot be split. An empty word has none."""
        children, link, pops = self.children, self.link, self.pops
        node = total = 0
        for c in word:
            while (below := children[node].get(c)) is None:
                total += pops[node]
                node = link[node]
                if node is None:
                    return UNKNOWN
            node = below
        while node > 1:
            total += pops[node]
            node = link[node]
            if node is None:
                return UNKNOWN
        return total


def marked_pieces(pieces: Iterable[str]) -> tuple[list[str], list[str]]:
    """Pieces that begin words and that continue them, of a vocabulary that writes the latter with ``##`` before them."""
    pieces = list(pieces)
    return [p for p in pieces if not p.startswith(CONTINUES)], [p[len(CONTINUES) :] for p in pieces if p.startswith(CONTINUES)]


def load_pieces(path: str) -> list[str]:
    """The strings of a BPE vocabulary, without the mark of word ends."""
    with open(path, encoding="utf-8") as file:
        strings = {t.removesuffix(WORD_END) for t in json.load(file)["model"]["vocab"]}
    return sorted(strings - {""})


class Counts(dict):
    """(tokens, unknown words) of a split word; filled as asked."""

    def __init__(self, matcher: LongestMatch):
        super().__init__()
        self.matcher, self.old = matcher, {}
        symbols = byte_symbols()
        self.symbols = [symbols[b] for b in range(256)]

    def __missing__(self, word: str) -> tuple[int, int]:
        found = self.old.pop(word, None)
        if found is None:
            symbols = self.symbols
            count = self.matcher.count("".join([symbols[b] for b in word.encode("utf-8", "surrogatepass")]))
            found = (1, 1) if count == UNKNOWN else (count, 0)  # an unknown word counts as one token
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def count_text(text: str | None, counts: Counts) -> tuple[int, int, int]:
    """(words, tokens, unknown words)."""
    parts = [counts[w] for w in split_words(normalise(text or ""))]
    return len(parts), sum([p[0] for p in parts]), sum([p[1] for p in parts])


def token_counts(docs: DataFrame, begin: Iterable[str], carry_on: Iterable[str]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every whole text; the trie is broadcast, its size is the vocabulary's."""
    sent = docs.sparkSession.sparkContext.broadcast(LongestMatch(begin, carry_on))

    def run(columns: dict[str, list], counts: Counts) -> dict[str, list]:
        found = [count_text(t, counts) for t in columns["text"]]
        return {"doc_id": columns["doc_id"], "n_words": [f[0] for f in found], "n_tokens": [f[1] for f in found], "n_unknown": [f[2] for f in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_words long, n_tokens long, n_unknown long", lambda: Counts(sent.value))


def op9(docs: DataFrame, path: str | None = None) -> DataFrame:
    pieces = load_pieces(path or tokenizer_path(MODEL))
    return token_counts(docs, pieces, pieces)
