"""Byte-pair encoding and decoding by a tokenization automaton.

The merges of a byte-level vocabulary are compiled into a deterministic automaton whose arcs are tokens and whose paths
are exactly the token sequences that the merges produce. It starts as one state with an arc for each byte. Each merge of u
and v adds a gadget, in order: wherever u could be read, so can the new token, and it leads to where v leads; the state
that u leads to (split from other tokens' states, if they share it) loses its arc v. A split state inherits what its
parent had lost by then, so a state stores its own losses only, one for each merge, and the automaton is as large as the
vocabulary. No two paths spell the same word, so encoding a word is a walk over arcs, longest token first, that gives up a
place for good once no arc leads on from it. Transitions and words met before come from tables of bounded size. Decoding
emits the arcs' labels.

Texts are cut at special tokens and then into words by the byte-level rule (contractions, letters, numbers, other signs,
white space), both in tasks that hold one automaton a worker; nothing is shuffled. The automaton is compiled on the driver
and broadcast: its size is the vocabulary's.

Defined cases: a null text counts as empty and gives no ids; null ids decode to an empty text; ids beyond the vocabulary
decode to nothing, bytes that are no UTF-8 to U+FFFD; texts of any length are encoded whole; every row is encoded for itself,
so repeated rows and null ids of documents stay; an empty table stays empty; input columns named like a result column are replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.llm.arrow import made_rows

if TYPE_CHECKING:
    import pyarrow as pa

#: Words and transitions that a worker remembers at most; then it starts anew.
WORDS, ARCS = 1 << 18, 1 << 19
#: Code points below which Unicode has its letters and numbers.
TOP = 0x40000
#: Fixed values of the byte-level rule.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + at) for at, b in enumerate(others)}


def _ranges(points: list[int]) -> str:
    """Ascending code points as the ranges of a character class."""
    own = np.array(points, np.int64)
    first = own[np.diff(own, prepend=-2) > 1]
    last = own[np.diff(own, append=1 << 32) > 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


def classes_of(tokenizer) -> tuple[list[int], list[int]]:
    """The letters and the numbers that a byte-level pre-tokenizer knows, asked of itself: a letter joins an ``a`` before it, a number a ``1`` behind it."""
    asked = [c for c in range(TOP) if not 0xD800 <= c < 0xE000 and chr(c) not in WHITE_SPACE]
    ends = {end for _, (_, end) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}1" for c in asked))}
    letters = [c for at, c in enumerate(asked) if 3 * at + 1 not in ends]
    return letters, [c for at, c in enumerate(asked) if 3 * at + 1 in ends and 3 * at + 2 not in ends]


def word_pattern(letters: list[int], numbers: list[int], top: int) -> re.Pattern:
    """The byte-level rule for texts whose code points are all below ``top``."""
    letter, number, space = (_ranges([c for c in own if c < top]) for own in (letters, numbers, sorted(map(ord, WHITE_SPACE))))
    return re.compile(f" ?[{letter}]+|{CONTRACTIONS}| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Automaton:
    """A deterministic automaton over tokens. vocab: byte tokens and merged ones by their letters; merges in order; special: strings taken whole; classes: letters and numbers."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int], classes: tuple[list[int], list[int]]):
        self.classes = classes
        letters = {letter: byte for byte, letter in byte_letters().items()}
        spelt = {token: bytes(letters[c] for c in text) for text, token in vocab.items() if text not in special}
        size = max([*spelt, *special.values()], default=-1) + 1
        self.special = special
        self.labels: list[bytes] = [b""] * size  # what an arc emits
        for token, label in [*spelt.items(), *((token, text.encode()) for text, token in special.items())]:
            self.labels[token] = label
        self.rank = array("q", [-1]) * size  # the merge that made a token; -1: a byte
        self.lead = array("q", [-1]) * size  # an arc is wherever its lead was when it was made
        self.target = array("q", [0]) * size  # the state an arc leads to; every byte leads back to the first
        self.parent, self.born, self.lost = array("q", [-1]), array("q", [-1]), [{}]
        self.longest = 1
        made = {token for token, label in spelt.items() if len(label) == 1}
        self.token = {self.labels[token]: token for token in made}
        shared = {0: len(made) + 1}  # tokens by state; the start counts as one
        self.arcs: dict[int, bool] = {}
        for at, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if u not in made or v not in made or w in made:
                raise ValueError(f"merge {at} joins what no earlier merge makes, or makes a token again: {left} {right}")
            made.add(w)
            if self.labels[u] in self.token and self.labels[v] in self.token and self.has_arc(self.target[u], v):
                self.token[self.labels[w]] = w
                self.longest = max(self.longest, len(self.labels[w]))
                self._gadget(at, u, v, w, shared)
            # else no word ever holds u before v at this merge, and nothing changes: w is on no path

    def _gadget(self, at: int, u: int, v: int, w: int, shared: dict[int, int]) -> None:
        """Add arc w beside arc u to where v leads, and take arc v from where u leads."""
        self.rank[w], self.lead[w], self.target[w] = at, u, self.target[v]
        shared[self.target[v]] += 1
        state = self.target[u]
        if shared[state] > 1:  # other tokens lead here too: u gets a state of its own
            shared[state] -= 1
            self.parent.append(state)
            self.born.append(at)
            self.lost.append({})
            state = self.target[u] = len(self.lost) - 1
            shared[state] = 1
        self.lost[state][v] = at

    def _losses(self, state: int) -> list[tuple[dict[int, int], int]]:
        """What a state and those it was split from have lost, and the merge before which that counts for it."""
        found, before = [], len(self.rank)
        while state >= 0:
            if self.lost[state]:
                found.append((self.lost[state], before))
            before, state = self.born[state], self.parent[state]
        return found

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may be read in ``state``: none of the arcs that it came from was lost before it was made."""
        by, losses = len(self.rank), self._losses(state)
        while True:
            for lost, before in losses:
                at = lost.get(token)
                if at is not None and at < before and at <= by:
                    return False
            by = self.rank[token]
            if by < 0:
                return True
            token = self.lead[token]

    def walk(self, word: bytes) -> tuple[int, ...]:
        """The tokens of the one path that spells ``word``."""
        token_of, arcs, size, target, longest, n = self.token.get, self.arcs, len(self.labels), self.target, self.longest, len(word)
        path: list[int] = []
        ends: list[int] = []  # where each token of the path ends
        dead: set[int] = set()  # where no arc leads on
        begin, state, last = 0, 0, min(n, longest)
        while begin < n:
            for end in range(last, begin, -1):
                token = token_of(word[begin:end])
                if token is None or end in dead:
                    continue
                key = state + token
                open_ = arcs.get(key)
                if open_ is None:
                    if len(arcs) >= ARCS:
                        arcs.clear()
                    open_ = arcs[key] = self.has_arc(state // size, token)
                if open_:
                    path.append(token)
                    ends.append(end)
                    begin, state, last = end, target[token] * size, min(n, end + longest)
                    break
            else:
                dead.add(begin)
                path.pop()
                last = ends.pop() - 1
                begin = ends[-1] if ends else 0
                state = target[path[-1]] * size if path else 0
        return tuple(path)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"arcs": {}}


class Encoder(dict):
    """An automaton with its tables: words met before, by text."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.ascii, self.narrow, self.wide = (word_pattern(*automaton.classes, top).findall for top in (0x80, 0x10000, TOP))
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(automaton.special, key=len, reverse=True)) + ")").split if automaton.special else lambda text: [text]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        ids = self[word] = self.automaton.walk(word.encode())
        return ids

    def encode(self, text: str) -> list[int]:
        special, ids = self.automaton.special, []
        for part in self.cut(text):
            if part in special:
                ids.append(special[part])
            else:
                split = self.ascii if part.isascii() else self.wide if self.beyond(part) else self.narrow
                ids += chain.from_iterable(map(self.__getitem__, split(part)))
        return ids


def automaton_of(tokenizer_path: str) -> Automaton:
    """The automaton of a byte-level BPE stored as JSON. Rules other than that one's are refused."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    stored = json.loads(tokenizer.to_str())
    model, before = stored["model"], stored["pre_tokenizer"] or {}
    plain = stored["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normalizer, prefix space, affixes and dropout")
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in stored["added_tokens"]):
        raise ValueError("only added tokens that are taken wherever they stand")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {x["content"]: x["id"] for x in stored["added_tokens"]}, classes_of(tokenizer))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(automaton: Automaton) -> Encoder:
    """One a worker, which goes on to other tasks."""
    if id(automaton) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(automaton)] = Encoder(automaton)
    return _ENCODERS[id(automaton)]


def _encoded(batches: Iterator[pa.RecordBatch], shared: Broadcast, ids_col: str, left: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    encode = _encoder(shared.value).encode
    return made_rows(batches, ["__text"], lambda text: (np.array(encode(text.as_py() or ""), np.int32),), {ids_col: pa.list_(pa.int32())}, left)


def _decoded(batches: Iterator[pa.RecordBatch], shared: Broadcast, text_col: str, left: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    labels = shared.value

    def spelt(ids: pa.ListScalar) -> tuple[bytes]:
        own = ids.values.drop_null().to_numpy() if ids.is_valid else np.zeros(0, np.int32)
        known = own[(own >= 0) & (own < len(labels))].tolist()
        return (b"".join(map(labels.__getitem__, known)).decode("utf-8", "replace"),)

    return made_rows(batches, ["__ids"], spelt, {text_col: pa.string()}, left)


def _mapped(df: DataFrame, given: Column, left: list[str], made: T.StructField, rows: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in left), made])
    return df.select(*left, given).mapInArrow(lambda it: rows(it), schema)


def encode(docs: DataFrame, automaton: Automaton, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) and ``ids_col``: the text's ids, an array of integers."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    left = [c for c in (docs.columns if keep is None else keep) if c != ids_col]
    field = T.StructField(ids_col, T.ArrayType(T.IntegerType()))
    return _mapped(docs, F.col(text_col).alias("__text"), left, field, lambda it: _encoded(it, shared, ids_col, left))


def decode(encoded: DataFrame, automaton: Automaton, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col``: the text that its ids spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(automaton.labels)
    left = [c for c in encoded.columns if c != text_col]
    return _mapped(encoded, F.col(ids_col).alias("__ids"), left, T.StructField(text_col, T.StringType()), lambda it: _decoded(it, shared, text_col, left))
