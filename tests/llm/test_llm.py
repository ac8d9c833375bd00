"""Encoding, mixing and content scoring: round trips, brute force and held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import abuse, mixing, tokenizer

TEXTS = ["", None, " ", "plain text", "tail  \r\n\ttabs", "naïve 😀👩‍💻 zwj", "价差明显收窄。" * 20, "<|endoftext|> is text", "\x00\x07 control", "é" * 7, "word " * 40_000, "à́̂"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None)], "doc_id long, text string, ids string")


def test_ids_equal_direct_encoding_and_come_back(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer.vocabulary())
    t.encode_special_tokens = True
    encoded = tokenizer.encode(docs)  # its own column ids gives way
    for r in encoded.where("doc_id is not null").collect():
        assert r.ids == t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
    assert {r.doc_id: r.text for r in tokenizer.decode(encoded).collect() if r.doc_id is not None} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert tokenizer.encode(docs.limit(0).select("doc_id", "text")).collect() == []
    counts = tokenizer.token_counts(docs.select("doc_id", "text")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in counts[1:]] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in TEXTS]


def test_pieces_equal_whole_texts_for_every_character():
    """Also for characters that the two tables of classes take differently."""
    rnd = random.Random(3)
    encoder = tokenizer.Encoder(tokenizer.vocabulary())
    assert encoder.by_piece
    characters = [chr(i) for i in [*range(1, 0x3000), *range(0x1F300, 0x1FA00), *range(0x16D00, 0x16E00), *range(0x11F00, 0x12000)]]
    texts = ["".join(rnd.choice(["a", "b", " ", "1", "!", "'", "'s", "\n"]) + c for c in characters[i : i + 40]) + rnd.choice([" ", "'ll  ", ""]) for i in range(0, len(characters), 40)]
    whole = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.ids(texts) == whole and encoder.odd
    assert encoder.counts(texts) == [len(x) for x in whole]
    assert encoder.ids(["x" * 5000, "", None]) == [encoder.tokenizer.encode("x" * 5000, add_special_tokens=False).ids, [], []]


def test_offsets_cover_split_characters(spark, docs):
    pieces = tokenizer.id_bytes(tokenizer.vocabulary())
    for r in tokenizer.encode_with_offsets(docs.where("doc_id is not null").select("doc_id", "text")).collect():
        text, place = TEXTS[r.doc_id] or "", 0
        for i, a, b in zip(r.ids, r.starts, r.ends):
            held = pieces[i]
            assert text[a:b].encode().find(held) >= 0
            place += len(held)
        assert place == len(text.encode())
        assert r.starts == sorted(r.starts) and (not r.ends or r.ends[-1] == len(text))


def seats_one_by_one(weights, seats, most):
    given = [0] * len(weights)
    for _ in range(min(seats, sum(m for w, m in zip(weights, most) if w > 0))):
        q = [w / (2 * g + 1) if g < m and w > 0 else -1 for w, g, m in zip(weights, given, most)]
        given[q.index(max(q))] += 1
    return given


def test_apportionment_equals_highest_quotients():
    rnd = random.Random(8)
    for _ in range(200):
        weights = [rnd.choice([0, 1, 3, 5.5, 100, rnd.random()]) for _ in range(rnd.randint(1, 7))]
        seats, most = rnd.randint(0, 60), [rnd.randint(0, 40) for _ in weights]
        assert mixing.apportion(np.array(weights, float), seats, np.array(most)).tolist() == seats_one_by_one(weights, seats, most)
    assert mixing.apportion(np.array([1.0, 3.0]), 10**12).sum() == 10**12


def test_mix_reaches_its_shares(spark):
    rnd = random.Random(9)
    data = [(i, rnd.choice(["big"] * 8 + ["small", None]), rnd.choice(["", None, "some words here " * rnd.randint(1, 30)])) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("copies", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("none", 0.2, 3), (None, 0.1, 1), ("odd", None, None)], "source string, target_share double, max_repeats int")
    mixed, plan, total = mixing.mix(docs, targets, block=32)
    report = {r.source: r for r in mixing.shares(mixed, plan, total).collect()}
    assert abs(report["big"].share_of_total - 0.5) < 0.01
    assert report["small"].most_copies == 2 and report["small"].mixed_tokens == 2 * report["small"].source_tokens
    assert report["none"].mixed_tokens == report["odd"].mixed_tokens == 0
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) == 1
    again = mixing.mix(docs.repartition(7), targets, block=32)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        m, p, n = mixing.mix(d, t)
        assert m.collect() == [] and all(not r.mixed_tokens for r in mixing.shares(m, p, n).collect())


def test_spelling_is_undone():
    plain = {w for t in ("You w0r7hl355 $tupid  p.i.g!", "so ｓｔｕｐｉｄ, m​o​r​o​n", "p a r a s i t e s", "veeeermin 蠢 猪") for w in " ".join(abuse.plain_windows(t)).split()}
    assert {"worthless", "stupid", "pig", "moron", "parasites", "vermin", "蠢猪"} <= plain
    assert abuse.plain_windows(None) == abuse.plain_windows("") == abuse.plain_windows(" \n") == []
    assert len(abuse.plain_windows("ab cd " * 100_000)) > 20_000


def test_unseen_documents_are_told_apart(spark):
    rnd = random.Random(5)
    ordinary = [f"The {a} of {b} was {c} on day {n}." for a in ("price", "volume", "basis", "fee") for b in ("gold", "wheat", "oil") for c in ("confirmed", "revised", "withdrawn") for n in range(3)]
    abusive = [f"{a}, you {b} {c}." for a in ("Listen", "Shut up", "Go away") for b in ("dirty", "rotten", "foul") for c in ("toad", "weasel", "worm")]
    def make(bad):
        return " ".join(rnd.sample(ordinary, 4) + ([rnd.choice(abusive)] if bad else []))

    reviewed = [(i, make(i % 5 == 0), float(i % 5 == 0)) for i in range(600)]
    model = abuse.fit(reviewed)
    held_out = [(make(i % 5 == 0), i % 5 == 0) for i in range(300)]
    right = sum((model.score(t) > model.threshold) == y for t, y in held_out)
    assert right >= 0.9 * len(held_out)
    docs = spark.createDataFrame([(1, held_out[0][0], "x"), (2, held_out[1][0], "x"), (3, None, None), (4, "", "y"), (None, "  ", "z")], "doc_id long, text string, score string")
    assert [(r.doc_id, r.abusive) for r in abuse.score_documents(docs, model).orderBy("doc_id").collect()] == [(None, False), (1, True), (2, False), (3, False), (4, False)]


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, abusive int")
    model = abuse.fit(abuse.reviewed_documents(docs, labels))
    assert model.score("you are a worthless piece of shit") > model.threshold > model.score("the policy forbids insults and threats")
    assert abuse.score_documents(docs.limit(0), model).collect() == []
