"""The rows of every stage of the corpus pipeline, on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rallyframe.llm import mixing, quality_rules, secrets
from rallyframe.plans.scratch import stash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input, with a secret in every ninth text, and the rows of each stage, each worked out from the one before."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    secret = F.concat("text", F.lit(' and then secret = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('" was set'))
    tables = [stash(docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, secret).otherwise(F.col("text"))), "test-documents")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stash(stage(spark, tables[-1], FOLDER), f"test-{name}"))
    return tables


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source").collect()))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_rules_keep_what_the_operator_keeps(spark, stages):
    docs, kept = stages[0], stages[1]
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")).collect()}
    assert rows(kept) == Counter({t: n for t, n in rows(docs).items() if judged[t[0]]}) and 0 < kept.count() < docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {t[0] for t in rows(kept)}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    clean = [i for i, q in labels.items() if q == 1 and words.get(i, 0) >= 50]
    assert sum(i in left for i in clean) >= 0.98 * len(clean)


def test_near_duplicates_keep_the_least_of_each_component(stages):
    docs, kept = stages[1], stages[2]
    sets = {t[0]: shingles(t[1]) for t in rows(docs)}
    at = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            at[s].append(i)
    both = Counter((a, b) for own in at.values() for a in own for b in own if a < b)
    low = {i: i for i in sets}
    links = [(a, b) for (a, b), k in both.items() if 10 * k >= 8 * (len(sets[a]) + len(sets[b]) - k)]
    for _ in range(len(sets)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert rows(kept) == Counter({t: n for t, n in rows(docs).items() if low[t[0]] == t[0]}) and kept.count() < docs.count()


def test_secrets_are_masked_by_place(spark, stages):
    docs, clean = stages[2], stages[3]
    found = defaultdict(set)
    for r in secrets.scan(docs, secrets.forest_of(docs)).where("is_secret").collect():
        found[r["doc_id"]].add(r["candidate"])
    after = {t[0]: t for t in rows(clean)}
    assert found and set(after) == {t[0] for t in rows(docs)}
    for t in rows(docs):
        text = after[t[0]][1]
        assert after[t[0]][2:] == t[2:]
        if not found[t[0]]:
            assert text == t[1]
        else:
            whole = [rf"(?<![A-Za-z0-9+/_\-]){re.escape(c)}(?![A-Za-z0-9+/_\-])" for c in found[t[0]]]
            assert text.count("[SECRET]") == (t[1] or "").count("[SECRET]") + sum(len(re.findall(w, t[1])) for w in whole) and not any(re.search(w, text) for w in whole)
    assert clean.where(F.col("n_chars") != F.length("text")).count() == 0


def test_mixture_repeats_as_often_as_the_mix_says(stages):
    docs, mixed = stages[3], stages[4]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).select("doc_id", "copies").collect()}
    assert rows(mixed) == Counter({t: n * copies[t[0]] for t, n in rows(docs).items() if copies[t[0]]})
    assert max(copies.values()) <= 2


def test_packing_is_whole_and_gapless(stages):
    docs, packed = stages[4], stages[5]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for (_, text, *_), n in rows(docs).items():
        want[np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += n
    pieces = packed.collect()
    ends, lone = Counter(), Counter()
    by_doc = defaultdict(list)
    for r in pieces:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
    for own in by_doc.values():  # copies of a document carry one id: each has as many pieces
        last = max(r["piece"] for r in own)
        whole = b"".join(bytes(next(r for r in own if r["piece"] == k)["ids"]) for k in range(last + 1))
        times = Counter(r["piece"] for r in own)
        assert len(set(times.values())) == 1
        lone[whole] += times[0]
    assert lone == want
    for r in pieces:
        ends[r["sequence_id"]] += r["length"]
    places = defaultdict(list)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"], r["exact"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))
        total = own[-1][0] + own[-1][1]
        assert total <= 2048 and (not own[0][2] or total == 2048)


def test_run_gives_the_last_stage(spark, stages):
    got, last = corpus_pipeline.run(spark, FOLDER), spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        last = stage(spark, last, FOLDER)
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(got) == key(last) and got.count() > 0
