"""Encoding and decoding, fill-in-middle and phrase mining on edge cases and against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rallyframe.llm import bpe, collocations, fill_in_middle
from rallyframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} naïve" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "one two three", "one two three", LONG, "<|endoftext|> a <|endoftext|>", "x<P>y", "ünïcode ßtraße 名前 😀 \x85\xa0　\x1c", "a" * 5000, "  'll don't   \n\n 12 3½"]
DOCS = "doc_id long, text string, lang string, ids string, output string, n int, phrase string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 else "en", "clash", "clash", 7, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (5, TEXTS[5], "en", None, None, None, None), (None, "null id", None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def automaton():
    return bpe.automaton_of(PATH)


def random_texts(n):
    rng = random.Random(3)
    signs = [*"aaabbeeettoo   \n\t'.,;1 2 3", "é", "名", "😀", "\x85", " in", "the", "'ll", "́", "<|endoftext|>"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return made + ["".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x2FFFF)])) for _ in range(30)) for _ in range(n)]


def test_encoder_equals_tokenizer(automaton):
    texts = [*random_texts(5000), *("a" * k for k in range(150)), *("ab" * k + "c" for k in range(60)), *(" " * k + "x" for k in range(40))]
    encoder, tokenizer = bpe.Encoder(automaton), Tokenizer.from_file(PATH)
    assert [encoder.encode(t) for t in texts] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def merged(word, merges):
    """The tokens of a word, merge by merge in order."""
    tokens = list(word)
    for left, right in merges:
        made, at = [], 0
        while at < len(tokens):
            both = tokens[at : at + 2] == [left, right]
            made.append(left + right if both else tokens[at])
            at += 2 if both else 1
        tokens = made
    return tokens


def test_automaton_has_one_path_per_word():
    """Small vocabularies with merges of equal and overlapping parts, over all words of two letters up to length 9."""
    rng = random.Random(5)
    for _ in range(25):
        tokens, merges = ["a", "b"], []
        for _ in range(rng.randint(1, 7)):
            left, right = rng.choice(tokens), rng.choice(tokens)
            if left + right not in tokens:
                merges.append((left, right))
                tokens.append(left + right)
        vocab = {t: at for at, t in enumerate(tokens)}
        own = bpe.Automaton(vocab, merges, {}, ([], []))
        for length in range(1, 10):
            for bits in range(2**length):
                word = "".join("ab"[bits >> k & 1] for k in range(length))
                want = merged(word, merges)
                assert [tokens[t] for t in own.walk(word.encode())] == want, (word, merges)
                if length <= 5:  # no other sequence of tokens that spells the word is a path
                    assert sum(path_of(own, [vocab[t] for t in cut]) for cut in cuts(word, [t for t in vocab if t.encode() in own.token])) == 1


def cuts(word, vocab):
    return [[]] if not word else [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in vocab for rest in cuts(word[k:], vocab)]


def path_of(own, tokens):
    state = 0
    for token in tokens:
        if not own.has_arc(state, token):
            return False
        state = own.target[token]
    return True


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="merge 0"):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], {}, ([], []))


def test_bpe_on_edge_rows(docs, automaton):
    tokenizer = Tokenizer.from_file(PATH)
    coded = bpe.decode(bpe.encode(docs, automaton), automaton)
    assert sorted(coded.columns) == sorted([*docs.columns, "decoded"])
    rows = coded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r["ids"]) == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == tokenizer.decode(r["ids"], skip_special_tokens=False) == (r["text"] or "")
    assert bpe.decode(bpe.encode(docs.limit(0), automaton), automaton).count() == 0


def test_bpe_decodes_any_ids(spark, automaton):
    tokenizer, rng = Tokenizer.from_file(PATH), np.random.default_rng(2)
    lists = [rng.integers(0, 50257, 12).tolist() for _ in range(300)] + [[-1, 64, 99999], None]
    got = bpe.decode(spark.createDataFrame([(k, ids) for k, ids in enumerate(lists)], "k long, ids array<int>"), automaton)
    for r in got.collect():
        known = [i for i in lists[r["k"]] or [] if 0 <= i < 50257]
        assert r["decoded"] == tokenizer.decode(known, skip_special_tokens=False)


def test_bpe_query(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_bpe"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


@pytest.mark.parametrize("stride", [1, 3, 256])
def test_checkpoints_find_every_cut(stride):
    for text in random_texts(150):
        units, points = UNITS.findall(text), fill_in_middle.Checkpoints(text.encode(), stride)
        assert points.n == len(units) and len(points.units) <= len(units) / stride + 2
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert points.after(k) == (len(before.encode()), len(before))


def brute_fill(doc_id, text):
    """The contract's words, with lists of units."""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_on_edge_rows(spark, docs):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(100), 100)], "doc_id long, text string")
    for table in (docs, more):
        made = fill_in_middle.restore(fill_in_middle.fill_in_middle(table))
        rows = made.collect()
        assert len(rows) == table.count()
        for r in rows:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fill(r["doc_id"], r["text"] or "")
            assert r["restored"] == (r["text"] or "")
    assert {"plain", "psm", "spm"} == {r["form"] for r in rows}
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(docs.limit(0))).count() == 0


def brute_phrases(rows, most, least, top, part=50):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            totals[lang or "und"] += len(words)
            counts.update((lang or "und", words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        longer = [b for (other, q), b in counts.items() if other == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= part * a for b in longer):
            score, _, l, r = min(cuts)  # noqa: E741
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, totals[lang], -s) for lang, own in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


@pytest.mark.parametrize(("most", "least", "top", "block"), [(3, 3, 50, 1 << 23), (4, 2, 7, 200), (2, 4, 1000, 1000)])
def test_phrases_equal_brute_force(spark, monkeypatch, most, least, top, block):
    rng = random.Random(most)
    words = ["A", "b", "Cé", "d", "b,", "e.f", "名", "\t", "", "a b c d", "a b c", "\x0b", "É"]
    rows = [(rng.choice(["en", None, "und", "fr"]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]) if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for _ in range(120)]
    monkeypatch.setattr(collocations, "BLOCK", block)
    got = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), most, least, top)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == brute_phrases(rows, most, least, top)


def test_phrase_edges(spark, docs):
    assert collocations.mine(docs.limit(0)).count() == 0
    assert collocations.mine(docs.where("doc_id < 4")).count() == 0
    rows = collocations.mine(docs, least=10).collect()  # of the long text: 977 words in turn with one other
    assert {r["lang"] for r in rows} == {"en"} and all(r["a"] >= 10 for r in rows)


def test_phrase_score_is_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 3_000_000_000_011
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score(*(_col(c) for c in "alr"))).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)
