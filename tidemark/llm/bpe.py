"""BPE encoding and decoding with a tokenization automaton.

Compiling: the automaton starts as one state with a loop for every base symbol. For each merge (a, b) in order a gadget is
added: the state that a-arcs lead to is copied without its b-arc, the a-arcs are moved to the copy, and every state with an
a-arc gets an arc for the merged token to where the b-arc led. All arcs of one label lead to the same state, so a state is
its parent and the one arc it lost, and an arc is absent exactly where an arc of its left spine was lost before the token
came. The paths are exactly the right tokenizations, one for each string. What is compiled, once, before any text is read:

* a reader: ``edges`` and ``fail`` take a node and a symbol to the next node, ``own`` and ``link`` name the tokens that end
  at a node, the longest first;
* ``lead``: the state to which the arcs of each token lead;
* ``lost``: for each token the ranges of states, numbered so that all copies follow their original, that lost its arc, and
  ``spines``: whose losses count for a token.

Encoding takes the different words of many texts at once, as arrays, and goes through them from left to right: at each place
the reader names the tokens that end there, and the one whose arc leaves the state at its beginning is the last step of the
one path to that place. Decoding emits the labels of the arcs. Arc tests are kept in a table of fixed size.

Text is normalised and split as ``word_bpe_49k.json`` says (NFC, white space to one space, lower case letter by letter,
then letters, single digits, contractions and runs of other characters; word ends are marked); special tokens that stand
in the text are tokens. A file with other settings or unknown fields is refused; its truncation and padding are not used.
A null text is an empty one: no tokens. Words of more than ``SHORT`` bytes are read one by one by the same tables, in time
and memory in proportion to their length. Repeated rows give repeated results, an empty table an empty one. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, tokenizer_path

MODEL, WORD_END = "word_bpe_49k.json", "</w>"
#: The end mark as one symbol after the bytes.
END = 256
#: Words of up to ``SHORT`` bytes are encoded ``TOGETHER`` at once; texts of about ``BATCH_BYTES`` share their words.
SHORT, TOGETHER, BATCH_BYTES, ARC_BITS = 48, 16_384, 4 << 20, 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Unicode's white space, as in the pattern's \\s (Python's has four control characters more).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def byte_symbols() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _character_class(wanted: str, most: int = sys.maxunicode) -> str:
    """Ranges of all characters up to ``most`` whose general category begins with ``wanted``, for a pattern."""
    ranges, start = [], None
    for code in range(most + 2):
        inside = code <= most and unicodedata.category(chr(code)).startswith(wanted)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append((start, code - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=3)
def word_pattern(most: int = sys.maxunicode) -> re.Pattern:
    """The words of a normalised text without characters beyond ``most``; the fewer there are, the faster."""
    letter, number = _character_class("L", most), _character_class("N", most)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")


def split_words(text: str) -> list[str]:
    """The words of a normalised text."""
    return word_pattern(0x7F if text.isascii() else 0xFFFF if max(text) <= "\uffff" else sys.maxunicode).findall(text)


def normalise(text: str) -> str:
    """NFC and lower case, letter by letter: a final sigma is like any other."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Automaton:
    """The compiled tokenization automaton; tokens are numbered as in the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        self.added = added or {}  # special tokens, which are cut out of a text before anything else
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.labels = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        left: dict[int, int] = {}  # of a merged token: its left part
        born: dict[int, int] = {}  # of a token: the merge that made it, 0 for base symbols
        state: dict[int, int] = {}  # where the arcs of a token lead
        made = {vocab[a + b] for a, b in merges}
        for token in vocab.values():
            if token not in made:
                born[token] = state[token] = 0

        def spine(token: int) -> list[tuple[int, float]]:
            """The token and its left parts, each with the merge before which its arc must not be lost."""
            found, until = [(token, float("inf"))], born[token]
            while token in left:
                token = left[token]
                found.append((token, until))
                until = born[token]
            return found

        parent, lost, time = [0], [-1], [0]  # of each state: what it is a copy of, without which arc, since which merge
        dead: set[int] = set()  # tokens that no path ever holds
        for k, (a, b) in enumerate(merges, 1):
            x, y, token = vocab[a], vocab[b], vocab[a + b]
            if token in born or token in dead or any(t not in born and t not in dead for t in (x, y)):
                raise ValueError(f"merge {k} makes a token twice or uses one that does not exist yet")
            present = x not in dead and y not in dead
            if present:
                needs, s = dict(spine(y)), state[x]
                while s and present:
                    present = not (lost[s] in needs and time[s] <= needs[lost[s]])
                    s = parent[s]
            if not present:
                dead.add(token)  # the pair never stands side by side
                continue
            target = state[y]  # before the arcs of x move, which matters for x = y
            left[token], born[token], state[token] = x, k, target
            parent.append(state[x])
            lost.append(y)
            time.append(k)
            state[x] = len(parent) - 1
        order, losses = _numbered(parent, lost, time)
        size = max(self.labels, default=0) + 1
        self.lead = np.full(size, -1, np.int64)
        for token, s in state.items():
            self.lead[token] = order[s]
        lost_at = sorted((part << 20 | first, last, when) for part, ranges in losses.items() for first, last, when in ranges)
        self.lost = np.array(lost_at, np.int64).reshape(-1, 3).T.copy()
        self.spines = [np.full((2, size), -1, np.int64)]  # by distance from the token: part, and until when
        for token in state:
            for depth, (part, until) in enumerate(p for p in spine(token) if p[0] in losses):
                if depth == len(self.spines):
                    self.spines.append(np.full((2, size), -1, np.int64))
                self.spines[depth][:, token] = part, min(until, 1 << 40)
        self._compile_reader(state)
        self.arc_keys = self.arc_values = self.scalar = None

    def _compile_reader(self, tokens: Iterable[int]) -> None:
        """The nodes are the beginnings of tokens, each found again from its key, which is its parent and its last symbol."""
        of_symbol = {s: b for b, s in byte_symbols().items()}
        step: dict[int, int] = {}
        below: list[list[int]] = [[]]
        own, length = [-1], [0]
        for token in tokens:
            label, node = self.labels[token], 0
            symbols = [of_symbol[c] for c in label.removesuffix(WORD_END)] + [END] * label.endswith(WORD_END)
            for symbol in symbols:
                key = node << 9 | symbol
                if key not in step:
                    step[key] = len(below)
                    below[node].append(symbol)
                    below.append([])
                    own.append(-1)
                    length.append(0)
                node = step[key]
            own[node], length[node] = token, len(symbols)
        fail, link = [0] * len(below), [0] * len(below)  # link: the next shorter node that is a token, 0 for none
        level = [0]
        while level:
            deeper = []
            for node in level:
                for symbol in below[node]:
                    child, at = step[node << 9 | symbol], fail[node]
                    while at and at << 9 | symbol not in step:
                        at = fail[at]
                    fail[child] = step.get(at << 9 | symbol, 0) if node else 0
                    link[child] = fail[child] if own[fail[child]] >= 0 else link[fail[child]]
                    deeper.append(child)
            level = deeper
        self.fail, self.own, self.length, self.link = (np.array(x, np.int64) for x in (fail, own, length, link))
        self.edges = _hashed(np.array([*step], np.int64), np.array([*step.values()], np.int64))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"arc_keys": None, "arc_values": None, "scalar": None}

    def _arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has the token's arc."""
        if self.arc_keys is None:
            self.arc_keys, self.arc_values = np.full(1 << ARC_BITS, -1, np.int64), np.zeros(1 << ARC_BITS, bool)
        keys = states << 20 | tokens
        slots = _slot(keys, ARC_BITS)
        known, present = self.arc_keys[slots] == keys, self.arc_values[slots]
        if not known.all():
            new = np.flatnonzero(~known)
            present[new] = self._tested(states[new], tokens[new])
            self.arc_keys[slots[new]] = keys[new]
            # two keys may share a slot: the value is that of the key that was written last
            last = self.arc_keys[slots[new]] == keys[new]
            self.arc_values[slots[new][last]] = present[new][last]
        return present

    def _tested(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys, lasts, times = self.lost
        present = np.ones(len(states), bool)
        if not len(keys):
            return present
        for parts, untils in self.spines:
            part = parts[tokens]
            at = np.searchsorted(keys, part << 20 | states, side="right") - 1  # ranges of one label do not overlap
            present &= ~((part >= 0) & (at >= 0) & (keys[at] >> 20 == part) & (lasts[at] >= states) & (times[at] <= untils[tokens]))
        return present

    def _next(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), np.int64)
        left = np.arange(len(nodes))
        while len(left):
            found = _looked_up(self.edges, nodes[left] << 9 | symbols[left])
            hit = found >= 0
            out[left[hit]] = found[hit]
            left = left[~hit]
            if len(left) and not nodes[left].all():
                raise ValueError("a symbol that no token holds")
            nodes = nodes.copy() if left.size else nodes
            nodes[left] = self.fail[nodes[left]]
        return out

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids): how many tokens each word has, and their numbers one word after the other."""
        lengths = np.array([len(w) for w in words], np.int64)
        counts, pieces = np.zeros(len(words), np.int64), []
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        longer = int(np.searchsorted(-lengths[order], -SHORT, side="left"))
        for w in order[:longer].tolist():
            ids = self._encode_long(words[w])
            counts[w] = len(ids)
            pieces.append((np.full(len(ids), w), np.arange(len(ids)), np.array(ids, np.int64)))
        for start in range(longer, len(order), TOGETHER):
            some = order[start : start + TOGETHER]
            pieces += self._encode_short([words[w] for w in some.tolist()], lengths[some], some, counts)
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for word, place, ids in pieces:
            out[begin[word] + place] = ids
        return counts, out

    def _encode_short(self, words: list[bytes], lengths: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """Words sorted by length, the longest first; all that are long enough take a step at once."""
        width, flat = int(lengths[0]), np.frombuffer(b"".join(words), np.uint8)
        offsets = np.cumsum(lengths) - lengths
        states, begins, tokens = (np.full((width + 2, len(words)), -1, np.int32) for _ in range(3))
        states[0] = 0
        nodes = np.zeros(len(words), np.int64)
        for place in range(1, width + 2):
            active = int(np.searchsorted(-lengths, 1 - place, side="right"))
            symbols = np.full(active, END, np.int64)
            inside = int(np.searchsorted(-lengths, -place, side="right"))
            symbols[:inside] = flat[offsets[:inside] + place - 1]
            nodes = self._next(nodes[:active], symbols)
            left = np.flatnonzero(lengths[:active] != place)  # the last symbol and the end mark are read as one
            at = nodes[left]
            at = np.where(self.own[at] >= 0, at, self.link[at])
            while len(left):
                token, begin = self.own[at], place - self.length[at]
                state = states[begin, left].astype(np.int64)
                fits = state >= 0
                fits[fits] = self._arcs(state[fits], token[fits])
                word = left[fits]
                states[place, word], begins[place, word], tokens[place, word] = self.lead[token[fits]], begin[fits], token[fits]
                left, at = left[~fits], self.link[at[~fits]]
                if not at.all():
                    raise ValueError("no path")
        steps, word, place = [], np.arange(len(words)), lengths + 1
        while len(word):
            steps.append((word, tokens[place, word]))
            place = begins[place, word].astype(np.int64)
            word, place = word[place > 0], place[place > 0]
        for word, _ in steps:
            counts[numbers[word]] += 1
        return [(numbers[word], counts[numbers[word]] - 1 - k, ids) for k, (word, ids) in enumerate(steps)]

    def _encode_long(self, word: bytes) -> list[int]:
        """The same for one word, symbol by symbol."""
        if self.scalar is None:
            edges = {k: v for k, v in zip(*(x.tolist() for x in self.edges), strict=True) if k >= 0}
            self.scalar = (edges, *(x.tolist() for x in (self.fail, self.own, self.length, self.link, self.lead)), {})
        edges, fail, own, length, link, lead, arcs = self.scalar
        node, states, begins, tokens = 0, [0], [0], [0]
        for place, symbol in enumerate([*word, END], 1):
            while (following := edges.get(node << 9 | symbol)) is None:
                if not node:
                    raise ValueError("a symbol that no token holds")
                node = fail[node]
            node = at = following
            step = (-1, -1, -1)
            while at and place != len(word):
                token = own[at]
                if token >= 0 and (state := states[place - length[at]]) >= 0:
                    present = arcs.get((state, token))
                    if present is None:
                        if len(arcs) >= 1 << ARC_BITS:
                            arcs.clear()
                        present = arcs[state, token] = bool(self._tested(np.array([state]), np.array([token]))[0])
                    if present:
                        step = lead[token], place - length[at], token
                        break
                at = link[at]
            states.append(step[0])
            begins.append(step[1])
            tokens.append(step[2])
        out, place = [], len(word) + 1
        while place:
            out.append(tokens[place])
            place = begins[place]
        return out[::-1]

    def encode(self, word: str) -> list[int]:
        """Token numbers of one split word, in the byte-level alphabet, without its end mark."""
        of_symbol = {s: b for b, s in byte_symbols().items()}
        return self.encode_many([bytes(of_symbol[c] for c in word)])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, as the tokenizer's file has no decoder: joined by spaces."""
        return " ".join([self.labels[i] for i in ids])


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash table with open places: (keys, values), -1 where empty, a quarter full at most."""
    bits = max(4, int(len(keys)).bit_length() + 2)
    table, held = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
    slots, left = _slot(keys, bits), np.arange(len(keys))
    while len(left):
        free = left[table[slots[left]] < 0]
        _, first = np.unique(slots[free], return_index=True)
        table[slots[free[first]]], held[slots[free[first]]] = keys[free[first]], values[free[first]]
        left = left[table[slots[left]] != keys[left]]
        slots[left] = (slots[left] + 1) & ((1 << bits) - 1)
    return table, held


def _looked_up(hashed: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The keys' values, -1 where there is none."""
    table, held = hashed
    bits = len(table).bit_length() - 1
    slots = _slot(keys, bits)
    found = table[slots]
    out = np.where(found == keys, held[slots], -1)
    left = np.flatnonzero((found != keys) & (found >= 0))
    while len(left):
        slots[left] = (slots[left] + 1) & ((1 << bits) - 1)
        found = table[slots[left]]
        hit = found == keys[left]
        out[left[hit]] = held[slots[left[hit]]]
        left = left[~hit & (found >= 0)]
    return out


def _numbered(parent: list[int], lost: list[int], time: list[int]) -> tuple[list[int], dict[int, list[tuple[int, int, int]]]]:
    """Numbers of the states in which all copies of a state follow it, and for each label the ranges that lost it: first, last, merge."""
    children: list[list[int]] = [[] for _ in parent]
    for s in range(1, len(parent)):
        children[parent[s]].append(s)
    order, last, stack, count = [0] * len(parent), [0] * len(parent), [(0, False)], 0
    while stack:
        s, done = stack.pop()
        if done:
            last[s] = count - 1
            continue
        order[s] = count
        count += 1
        stack.append((s, True))
        stack.extend((c, False) for c in children[s])
    losses: dict[int, list[tuple[int, int, int]]] = {}
    for s in range(1, len(parent)):
        losses.setdefault(lost[s], []).append((order[s], last[s], time[s]))
    return order, losses


#: The settings of the file that this module implements.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
MODEL_SETTINGS = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": WORD_END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}


def load(path: str) -> Automaton:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, added = data["model"], data.get("added_tokens", [])
    differs = [k for k in (SETTINGS.keys() | data.keys()) - {"version", "truncation", "padding", "added_tokens", "model"} if data.get(k) != SETTINGS.get(k)]
    differs += [k for k in (MODEL_SETTINGS.keys() | model.keys()) - {"vocab", "merges"} if model.get(k, MODEL_SETTINGS.get(k)) != MODEL_SETTINGS.get(k)]
    differs += [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if differs:
        raise ValueError(f"settings not known here: {sorted(differs)}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in added})


class Encoder:
    """Encodes texts together; its tables of strings are made once a task."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        size = len(automaton.lead)
        labels = [automaton.labels.get(i) for i in range(size)]
        self.labels, self.numbers = pa.array(labels, pa.large_string()), pa.array(map(str, range(size)), pa.large_string())

    def _split(self, text: str) -> list[str]:
        """The words of a text; special tokens begin with a space, which no word holds."""
        special = self.automaton.special
        if special is None or not special.search(text):
            return split_words(normalise(text))
        out: list[str] = []
        for i, piece in enumerate(special.split(text)):  # every second piece is a special token
            out += [f" {piece}"] if i % 2 else split_words(normalise(piece))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each distinct word, their ids, how many words each text has, numbers of the texts' words)."""
        split = [self._split(t or "") for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        del split  # many small strings
        distinct = coded.dictionary.to_pylist()
        counts, ids = self.automaton.encode_many([b"" if w[0] == " " else w.encode() for w in distinct])
        special = [i for i, w in enumerate(distinct) if w[0] == " "]
        if special:
            ids = np.insert(ids, (np.cumsum(counts) - counts)[special], [self.automaton.added[distinct[i][1:]] for i in special])
            counts[special] = 1
        return counts, ids, lengths, coded.indices.to_numpy().astype(np.int64)

    def rows(self, texts: list[str | None], with_ids: bool) -> dict[str, object]:
        counts, ids, lengths, of = self.encode(texts)
        begin = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        tokens = np.concatenate([[0], np.cumsum(counts[of])])[ends]
        out: dict[str, object] = {"n_tokens": np.diff(tokens)}
        for name, strings in (("ids_sha256", self.numbers), ("decoded_sha256", self.labels)):
            words = pc.binary_join(pa.ListArray.from_arrays(np.append(begin, len(ids)).astype(np.int32), strings.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))
            joined = pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), words.take(pa.array(of))), pa.scalar(" ", pa.large_string()))
            out[name] = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
        if with_ids:
            each = counts[of]
            place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            out["ids"] = pa.ListArray.from_arrays(tokens.astype(np.int32), ids[np.repeat(begin[of], each) + place])
        return out


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the tokens of every whole text, and digests.

    ``ids_sha256``: of the decimal numbers joined by one space; ``decoded_sha256``: of the decoded text in UTF-8, both in
    lower-case hex. The automaton is compiled once and broadcast; its size is the vocabulary's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(path or tokenizer_path(MODEL)))

    def run(columns: dict[str, list], encoder: Encoder) -> dict[str, object]:
        return {"doc_id": columns["doc_id"]} | encoder.rows(columns["text"], with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(rows, run, schema, lambda: Encoder(sent.value), BATCH_BYTES)


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode_documents(docs, path, with_ids=False)
