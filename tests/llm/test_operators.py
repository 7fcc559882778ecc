"""Each operator over the hard table, an empty table, and against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hard_table import PASSAGE, TEXTS, sentence
from pyspark.sql import functions as F

from ruleweave.llm import bwt_dedup, chat, common, decontam, langid, lattice, licenses, sharding, simhash, sp_codec, token_counts
from ruleweave.llm.components import connected

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# 1 and 8


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_on_the_hard_table(docs, nothing, library):
    got = sp_codec.encode_decode(docs, MODEL)
    expected = Counter()
    for i, t in TEXTS:
        ids = library.encode(t or "")
        expected[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert multiset(got.collect()) == expected
    assert sp_codec.encode_decode(nothing, MODEL).collect() == []
    kept = sp_codec.encode_decode(docs.where("doc_id = 9"), MODEL, keep=True).first()
    assert kept["ids"] == library.encode(TEXTS[8][1]) and kept["decoded"] == library.decode(kept["ids"])


def test_codec_and_counter_on_random_texts(library):
    model = open(MODEL, "rb").read()
    codec, counter = sp_codec.Codec(model), token_counts.Counter(model, "model")
    rng = random.Random(1)
    texts = ["".join(rng.choice(" ab▁\n.,é①😀the<s>") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 300, "ab" * 400, " ", "  ", "a ", " a", "a  ", "▁", "▁ ", "\n" * 90]
    for text, n in zip(texts, counter.count(texts)):
        ids = library.encode(text)
        assert codec.encode(text) == ids and n == len(ids) and codec.decode(ids) == library.decode(ids), text
    for _ in range(500):
        ids = [rng.randint(3, 600) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_texts_without_spaces_are_split_and_not_kept(library, monkeypatch):
    model = open(MODEL, "rb").read()
    rng = random.Random(4)
    texts = ["".join(rng.choice("漢字仮名交じり文の例abcXYZ0189+/=é😀") for _ in range(n)) for n in (65, 500, 9_000, 30_000)] + ["x" * 20_000, "A1b2" * 5_000]
    for long in (50, 4096):
        monkeypatch.setattr(token_counts, "LONG", long)
        counter = token_counts.Counter(model, "model")
        assert counter.count(texts) == [len(library.encode(t)) for t in texts]
        assert any(len(counter.pieces_of(t)) > 1 for t in texts) and all(len(k) <= token_counts.WIDEST for k in counter.known)
    codec = sp_codec.Codec(model)
    for t in texts:
        assert codec.encode(t) == library.encode(t)
    assert all(len(k) <= 64 for k in [*codec.words, *codec.segments])


def test_both_agendas_agree():
    codec = sp_codec.Codec(open(MODEL, "rb").read(), check=False)
    for seed in range(60):
        symbols = list("▁" + sentence(seed + 1, 8).replace(" ", ""))
        assert codec._short(list(symbols)) == codec._long(list(symbols))


def test_a_wrong_agenda_is_noticed():
    codec = sp_codec.Codec(open(MODEL, "rb").read())
    codec.order = {k: -v for k, v in codec.order.items()}
    with pytest.raises(ValueError, match="differ"):
        codec.encode("tokenization of many words")


def test_counts_on_the_hard_table(docs, nothing, library):
    got = token_counts.token_counts(docs, MODEL, max_tokens=100, batch_bytes=1000)
    expected = Counter((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in TEXTS)
    assert multiset(got.collect()) == expected
    assert token_counts.token_counts(nothing, MODEL).collect() == []


def test_counts_of_json_vocabularies(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs.where("doc_id < 10"), path).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in TEXTS if i and i < 10}


# 2


def test_language_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    total, by_word = 0.0, np.zeros((4, 2))
    for code in range(16):
        labels = [(code >> i) & 1 for i in range(4)]
        start = np.exp(move[:, labels[0]]).sum()
        w = start * np.exp(sum(scores[i, k] for i, k in enumerate(labels)) + sum(move[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        for i, k in enumerate(labels):
            by_word[i, k] += w
    assert np.allclose(langid.word_probabilities(scores.astype(np.float32), np.array([4]), move), by_word / total, atol=1e-5)


def test_language_blocks_match_one_pass():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 63, 64, 65, 300])
    scores, move = rng.normal(size=(sizes.sum(), 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    got, at = langid.word_probabilities(scores, sizes, move), 0
    for n in sizes:
        node, _ = langid.marginals(np.exp(scores[at : at + n].astype(float))[None], np.ones((1, n), bool), np.exp(move.astype(float)))
        assert np.allclose(got[at : at + n], node[0])
        at += n


def test_language_learns_and_labels_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = langid.train(docs)
    found = langid.predict(docs, field).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and found.where("score < 0 or score > 1").count() == 0
    crc = {r["doc_id"]: r["held_out"] for r in found.select("doc_id", "held_out").collect()}
    assert crc == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in crc}
    a, b = (docs.where(f"lang = '{x}' and n_chars > 400").orderBy("doc_id").first()["text"][:300] for x in ("en", "fr"))
    labels = [k for _, k, _ in langid.label_words(field, f"{a} {b}")]
    half = len(langid.WORD.findall(a))
    assert labels[:half].count("en") > 0.85 * half and labels[half:].count("fr") > 0.85 * (len(labels) - half)


def plain_prediction(field, text):
    """(language, score) by forward-backward over single words in plain Python, every word scored by itself."""
    words, at = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            at += c
        elif at:
            words, at = [*words, at], ""
    if not words or not field.labels:
        return "und", 0.0
    n = len(field.labels)
    x = [np.exp(e - e.max()) for e in (field.emissions([w])[0].astype(float) for w in words)]
    move = np.exp(field.move.astype(float))
    forward, backward = [], [np.ones(n)]
    f = np.ones(n) / n
    for e in x:
        f = (f @ move) * e
        f = f / f.sum()
        forward.append(f)
    for e in x[:0:-1]:
        b = move @ (e * backward[0])
        backward.insert(0, b / b.sum())
    marginal = [f * b / (f * b).sum() for f, b in zip(forward, backward)]
    mean = np.mean(marginal, axis=0)
    return field.labels[int(mean.argmax())], float(mean.max())


def test_language_predictions_match_a_plain_implementation(spark, docs):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    field = langid.train(known)
    rows = [(300 + k, t) for k, (i, t) in enumerate(TEXTS) if i != 10] + [(100 + i, r["text"]) for i, r in enumerate(known.orderBy("doc_id").limit(60).collect())]
    rows += [(200, "½ ² ① Ⅷ 12_3"), (201, "½x²"), (202, "été " * 300), (203, "x" * 200 + " " + "ab" * 70)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), field).collect()}
    for i, t in rows:
        lang, score = plain_prediction(field, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, (i, got[i], lang, score)
    assert got[200] == ("und", 0.0) and got[201][0] != "und"


def test_language_training_draws_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.Field, "fit", lambda self, sequences: seen.extend(w for ws, _ in sequences for w in ws))
    words = ["".join("abcdefghij"[int(c)] for c in str(100_000 + k)) for k in range(3_000)]
    texts = [(1, " ".join(words), "aa"), (2, "only this", "bb")] + [(k, "x y", f"l{k}") for k in range(3, 40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").where(~langid.held_out("doc_id"))
    field = langid.train(df, most=1_000_000)
    assert set(field.labels) == {r["lang"] for r in df.select("lang").distinct().collect()}
    if df.where("doc_id = 1").count():
        assert len(set(seen) & set(words)) > 2_950  # but words cut by the end of a passage
    assert len(langid.train(df, most=4).labels) == df.select("lang").distinct().count()


def test_language_stage_keeps_columns_of_any_name(spark):
    rows = [(1, "the house of the man", 7.0, "mine", "a"), (2, "123", 8.0, "own", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double, lang_pred string, `odd.name` string")
    field = langid.train(spark.createDataFrame([(k, "the house of the man", "en") for k in range(20)] + [(k, "das haus des mannes", "de") for k in range(20, 40)], "doc_id bigint, text string, lang string"))
    assert [tuple(r) for r in langid.accepted(df, field).collect()] == rows[:1]


def test_language_on_the_hard_table(docs, nothing):
    field = langid.train(docs)
    got = langid.predict(docs, field).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {2, 3, 4, 13} <= und and 10 not in und and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert langid.predict(nothing, field).collect() == []
    untaught = langid.train(nothing)
    assert {r["lang_pred"] for r in langid.predict(docs, untaught).collect()} == {"und"}
    kept = langid.accepted(docs, field, 0.0)
    assert kept.columns == docs.columns and kept.where("doc_id = 13").count() == 0


# 3


def brute_hits(texts, items, n=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1) if w else ():
            windows[tuple(w[k : k + m])].add(i)
    out = Counter()
    for i, t in texts:
        w, hit, named = cut(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    named |= found - {None}
        out[(i, len(w), len(hit), len(named), sha(",".join(sorted(map(str, named)))), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    return out


ITEMS = [(1, PASSAGE), (10, PASSAGE.upper()), (2, "long long"), (3, None), (4, ""), (5, "x"), (None, sentence(4, 14)), (2, "long long"), (7, "é😀 ①ﬁ")]


def test_decontamination_on_the_hard_table(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("window", F.lit(1)).withColumn("m", F.lit(2))
    got = decontam.decontaminate(docs, items)
    assert multiset(got.drop("spans").collect()) == brute_hits(TEXTS, ITEMS)
    assert sum(s["m"] for s in got.where("doc_id = 5").first()["spans"]) == got.where("doc_id = 5").first()["n_hit"]
    assert decontam.decontaminate(nothing, items).collect() == []
    assert multiset(decontam.decontaminate(docs, items.where("false")).drop("spans").collect()) == brute_hits(TEXTS, [])
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(k[0] for k in brute_hits(TEXTS, ITEMS).elements() if not k[5])


def test_decontamination_by_shuffled_join(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert multiset(decontam.decontaminate(docs, items).drop("spans").collect()) == brute_hits(TEXTS, ITEMS)


# 4


def brute_repeats(texts, length=50):
    seen = {}
    for i, t in texts:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                seen[b[k : k + length]] = min(i, seen.get(b[k : k + length], i))
    out = Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1) if i is not None else ():
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = True
        gone = gone[: len(b)]
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0))
        out[(i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))] += 1
    return out


def test_repeats_on_the_hard_table(docs, nothing):
    assert multiset(bwt_dedup.repeated_bytes(docs).collect()) == brute_repeats(TEXTS)
    assert bwt_dedup.repeated_bytes(nothing).collect() == []
    kept = bwt_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in TEXTS)


def test_repeats_of_low_complexity_and_edges(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab \n") for _ in range(400)) for _ in range(6)]
    texts = [(i, "".join(base[rng.randrange(6)][(a := rng.randrange(300)) : a + rng.randint(30, 120)] for _ in range(6))) for i in range(60)]
    texts += [(100, "ab" * 300), (101, "ba" * 200), (102, "a" * 500), (103, "a" * 49), (104, "a" * 50), (105, "é" * 60), (106, "x" + "é" * 60)]
    rng.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    assert multiset(bwt_dedup.repeated_bytes(df).collect()) == brute_repeats(texts)


def least_by_string(parts, ids, length):
    smallest = {}
    for p, d in zip(parts, ids):
        for k in range(len(p) - length + 1):
            smallest[p[k : k + length]] = min(d, smallest.get(p[k : k + length], d))
    return smallest


@pytest.mark.parametrize(("shards", "widest", "length"), [(1, 63, 50), (2, 63, 50), (4, 7, 50), (4, 1, 50), (3, 63, 33), (4, 63, 80)])
def test_merged_transforms_give_repeated_intervals(shards, widest, length):
    rng = random.Random(shards + widest)
    base = ["".join(rng.choice("ab c\nde") for _ in range(140)) for _ in range(4)]
    parts = [rng.choice(base)[(i := rng.randint(0, 30)) : i + rng.randint(length, length + 10)].encode() for _ in range(80)]
    ids = np.array([rng.randint(0, 50) for _ in parts])
    seen = {}
    first, least = bwt_dedup.least_documents(parts, ids, length, ids % shards, widest, seen)
    smallest = least_by_string(parts, ids, length)
    assert all(least[a + k] == smallest[p[k : k + length]] for p, a in zip(parts, first) for k in range(len(p) - length + 1))
    assert seen["shards"] == shards


def test_merged_order_and_common_prefixes():
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 30))).encode() for _ in range(30)]
    n, depth = sum(map(len, parts)), 12
    text = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) - 96
    ends = np.cumsum([len(p) for p in parts])
    after, back = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1], back[ends - np.array([len(p) for p in parts])] = ends - np.array([len(p) for p in parts]), ends - 1
    rotations = [(p[i:] + p[:i])[:depth] for p in parts for i in range(len(p))]
    owner = np.repeat(np.arange(len(parts)) % 3, [len(p) for p in parts])
    shards = [bwt_dedup.transform({1: text.astype(np.uint16)}, {1: back}, [1] * depth, np.nonzero(owner == k)[0].astype(np.int32)) for k in range(3)]
    order, common = bwt_dedup.merge(shards, [1] * depth)
    ordered = [rotations[i] for i in order]
    assert ordered == sorted(rotations) and sorted(order.tolist()) == list(range(n))
    shared = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(ordered, ordered[1:])]
    assert common[1:].tolist() == shared


def test_most_spans_come_from_merged_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "cast(coalesce(text, '') as binary)").orderBy("doc_id").toArrow()
    found = [r for b in bwt_dedup._find_runs(50, 1)(docs.to_batches()) for r in zip(*(c.to_pylist() for c in b.columns))]
    at_once = sum(len(bwt_dedup.unpack(blob)[0]) for _, kind, blob in found if kind == bwt_dedup.SPANS)
    batch = bwt_dedup._rows([r for r in found if r[1] == bwt_dedup.SEEN])
    rows = [r for b in bwt_dedup._match(1)([batch]) for r in zip(*(c.to_pylist() for c in b.columns))]
    blobs = {k: [blob for _, kind, blob in rows if kind == k] for k in (bwt_dedup.SEEN, bwt_dedup.WANTED)}
    packed = [blob for b in bwt_dedup._pack_documents(1)(docs.to_batches()) for blob in b.column(2).to_pylist()]
    cut = [r for b in bwt_dedup._cut_out(50)(0, {bwt_dedup.TEXTS: packed, bwt_dedup.WANTED: blobs[bwt_dedup.WANTED]}) for r in b.column(2).to_pylist()]
    seen = {}
    merged = sum(len(s[0]) for s in bwt_dedup.spans_of_bucket(bwt_dedup._pieces(cut), bwt_dedup._columns(blobs[bwt_dedup.SEEN]), 50, seen))
    assert merged > 10 * at_once and seen["shards"] == bwt_dedup.SHARDS and seen["merged"] > 10, (merged, at_once, seen)


def test_common_fragments_go_once_a_task(spark):
    texts = [(i, f"{sentence(5, 40)} {sentence(i, 30)}") for i in range(200)]
    batch = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("doc_id", "cast(text as binary)").toArrow().to_batches()
    kinds = Counter()
    for b in bwt_dedup._find_runs(50, 1)(batch):
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            kinds[kind] += len(bwt_dedup.unpack(blob)[0])
    assert kinds[bwt_dedup.SPANS] > 1500
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert multiset(bwt_dedup.repeated_bytes(df).collect()) == brute_repeats(texts)


@pytest.mark.parametrize("length", [20, 33, 77, 150])
def test_repeats_of_other_lengths(spark, length):
    texts = [(i, f"{sentence(i % 5, 40)} {sentence(i % 7, 30)} {sentence(i, 9)}") for i in range(40)] + [(12, sentence(3, 50)), (3, sentence(1, 60))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert multiset(bwt_dedup.repeated_bytes(df, length).collect()) == brute_repeats(texts, length)


def test_repeats_keep_own_columns(spark):
    rows = [(1, PASSAGE, "A"), (2, f"{PASSAGE} x", "B"), (2, "other text", "C"), (2, "other text", "D"), (None, PASSAGE, "E")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, src string")
    df = df.withColumns({"when": F.lit("2024-05-06 07:08:09").cast("timestamp"), "odd.name": F.array(F.struct(F.lit(1).alias("a"))), "id": F.lit(1.5).cast("decimal(9,2)"), "m": F.create_map(F.lit("k"), F.lit(b"v"))})
    got = bwt_dedup.without_repeats(df)
    assert got.dtypes == df.dtypes and sorted(str(r[3:]) for r in got.collect()) == sorted(str(r[3:]) for r in df.collect())
    kept = {r["src"]: (r["doc_id"], r["text"]) for r in got.collect()}
    assert kept == {"A": (1, PASSAGE), "B": (2, " x"), "C": (2, "other text"), "D": (2, "other text"), "E": (None, PASSAGE)}


# 5


def test_chat_round_trip():
    rng = random.Random(3)
    marks = ["[INST]", " [/INST]", "</s>", "<s>", "\\", "[", "]", " ", "a", "[ROLE ", "[/ROLE]", "\n", "[ASST] ", "=", "-", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", None, "tool", "a] b\\"]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        formatted = chat.BEGIN + "".join(chat.render(*t)[0] for t in turns)
        assert [p[:2] for p in chat.parse(formatted)] == turns


def test_chat_folds_events(spark):
    events = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "he"), (1, 3, "delta", 1, None, "lo"), (1, 2, "delta", 1, None, "l"),
        (1, 4, "message", 2, "user", "next"), (1, 5, "regenerate", 1, None, "new "), (1, 6, "delta", 1, None, "answer"), (1, 7, "message", 3, "user", "ok"),
        (1, 8, "edit", 0, None, "hello"), (None, None, None, None, None, None), (2, 0, "message", 0, "assistant", "x" * 100_000),
    ]
    log = spark.createDataFrame(events, chat.EVENTS).withColumn("part", F.lit(1)).repartition(3)
    parts = defaultdict(list)
    for r in chat.format_log(log).orderBy("conv_id", "turn").collect():
        parts[r["conv_id"]].append(r)
    assert [t[:2] for t in chat.parse("".join(r["part"] for r in parts[1]))] == [("user", "hello"), ("assistant", "new answer"), ("user", "ok")]
    assert [r["part"][r["loss_start"] : r["loss_end"]] for r in parts[1] if r["loss_start"]] == ["new answer"]
    digest = {r["conv_id"]: r for r in chat.format_log(log, digest=True).collect()}
    assert digest[1]["n_turns"] == 3 and digest[1]["loss_sha256"] == sha("new answer") and digest[1]["turns_sha256"] == sha("user\nhello\nassistant\nnew answer\nuser\nok\n")
    assert digest[2]["loss_chars"] == 100_000 and digest[None]["n_turns"] == 1
    assert chat.format_log(log.where("false")).collect() == chat.format_log(log.where("false"), digest=True).collect() == []


# 6


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards

    while low < high:
        low, high = (low, m) if fits(m := (low + high) // 2) else (m + 1, high)
    return low


@pytest.mark.parametrize("bins, fine", [(65_536, 512), (8, 4)])
def test_sharding_is_minimax(spark, monkeypatch, bins, fine):
    monkeypatch.setattr(sharding, "BINS", bins)
    monkeypatch.setattr(sharding, "FINE", fine)
    rng = random.Random(4)
    sizes = [rng.randint(1, 400) if rng.random() < 0.95 else rng.randint(400, 3000) for _ in range(300)]
    ends = np.cumsum(sizes).tolist()
    held = sharding.Ends(spark.createDataFrame([(e,) for e in ends], "end bigint"), ends[-1])
    capacity, cuts = sharding.minimax_cuts(held, 7, max(sizes))
    loads = np.diff([0, *cuts]).tolist()
    assert capacity == brute_capacity(sizes, 7) and max(loads) == capacity and cuts[-1] == ends[-1] and set(cuts) <= set(ends)


def test_sharding_on_the_hard_table(docs, nothing):
    rows = sharding.shard_rows(docs, 4).collect()
    text = {i: t or "" for i, t in TEXTS}
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in TEXTS)
    by_shard, by_crc = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        by_crc[r["text_crc32"], r["size"]].add(r["shard"])
        if r["doc_id"] is not None:
            assert r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(4))
    assert all(len(s) == 1 for s in by_crc.values())
    assert sharding.shard_rows(nothing, 4).collect() == []


# 7


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_simhash_on_the_hard_table(docs, nothing):
    fps = [brute_fingerprint(t) for _, t in TEXTS]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(TEXTS, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(TEXTS, fps, roots))
    assert multiset(simhash.near_duplicates(docs).collect()) == expected
    assert simhash.near_duplicates(nothing).collect() == []
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id = 1").count() == 1


def test_simhash_keeps_the_last_copy_of_a_repeated_id(spark):
    a, b = sentence(1, 60), sentence(2, 80)
    df = spark.createDataFrame([(1, a, "A"), (5, a, "B"), (5, b, "C"), (7, b, "D"), (7, b, "E")], "doc_id bigint, text string, src string")
    assert {r["src"] for r in simhash.one_of_each(df).collect()} == {"A", "C"}


def test_spread_join_of_hot_keys(spark):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 50) as k", "id")
    right = spark.range(60).selectExpr("id as k", "id * 2 as v")
    got = common.spread_join(left, right, "k", limit=100)
    assert sorted((r["k"], r["id"], r["v"]) for r in got.collect()) == sorted((r["k"], r["id"], 2 * r["k"]) for r in left.collect())


def near_values(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    out = []
    for _ in range(n):
        v = int(base[rng.integers(12)])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            v ^= 1 << int(b)
        out.append(v - (1 << 64) if v >= 1 << 63 else v)
    return sorted(set(out))


def test_anchors_meet_every_pair():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 4000, dtype=np.int64)
    flip = np.zeros(4000, np.uint64)
    for i in range(4000):
        for b in rng.choice(64, 4, replace=False):
            flip[i] |= np.uint64(1) << np.uint64(b)
    y = (x.view(np.uint64) ^ flip).view(np.int64)
    a, b = (set(zip(*(c.tolist() for c in simhash.anchors(v)))) for v in (x, y))
    assert len({r for r, _ in a & b}) == 4000


@pytest.mark.parametrize("hot", [20_000, 5])
def test_simhash_components_with_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    values = near_values(400, 6)
    links = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp bigint"))
    roots = {r["node"]: r["root"] for r in connected(links).collect()}
    expected = brute_components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert [roots.get(v, v) for v in values] == [values[r] for r in expected]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# 9


def brute_links(rows):
    sound = lambda v, k: k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    vs = [(i, np.array(v, float) if sound(v, k) else None, k) for i, v, k in rows]

    def linked(a, b):
        return a[1] is not None and b[1] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98

    roots = brute_components(vs, linked)
    least = {}
    for (i, _, _), r in zip(vs, roots):
        least[r] = min(i, least.get(r, i))
    return Counter((a[0], sum(linked(a, b) for j, b in enumerate(vs) if j != i), least[r], a[0] == least[r]) for i, (a, r) in enumerate(zip(vs, roots)))


def vectors(seed, n=120, d=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(8, d))
    out = []
    for i in range(n):
        v = base[rng.integers(8)] + rng.normal(size=d) * rng.choice([0.0, 0.02, 0.12])
        out.append((i, [float(x) for x in v], int(rng.integers(2))))
    zero = [0.0] * d
    out += [(n, None, 1), (n + 1, zero, 1), (n + 2, [None] + zero[1:], 1), (n + 3, [float("nan")] + zero[1:], 1), (n + 4, [float("inf")] + zero[1:], 1)]
    out += [(n + 5, out[0][1], None), (n + 6, [], 0), (n + 7, [-0.0] * (d - 1) + [1.0], 0), (n + 8, zero[1:] + [2.0], 0), (n + 9, out[3][1], out[3][2]), (n + 10, [1.0, 2.0], 0), (n + 11, [2.0, 4.1], 0)]
    return out


@pytest.mark.parametrize("hot", [8000, 10])
def test_embeddings_on_a_hard_table(spark, monkeypatch, hot):
    monkeypatch.setattr(lattice, "HOT", hot)
    rows = vectors(7)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("class", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    assert multiset(lattice.near_duplicates(df).collect()) == brute_links(rows)
    assert lattice.near_duplicates(df.where("false")).collect() == []


def test_lattice_decoding_and_recall():
    rng = np.random.default_rng(8)
    y = rng.normal(size=(300, 8)) * 2
    near = lattice.nearest(y)
    best = ((y - near) ** 2).sum(axis=1)
    assert (best[:, None] <= ((y[:, None, :] - (near[:, None, :] + lattice.SHORTEST)) ** 2).sum(axis=2) + 1e-9).all() and best.max() <= 1 + 1e-9
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(3000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = lattice.cells(x), lattice.cells(0.98 * x + np.sqrt(1 - 0.98**2) * z)
    met = np.any([lattice._meet(a[:, t], b[:, t]) | lattice._meet(b[:, t], a[:, t]) for t in range(lattice.TABLES)], axis=0)
    assert met.mean() > 0.998


# 10


def test_licenses(spark, docs, nothing):
    t = licenses.TEMPLATES
    mit = t["mit"].split()
    texts = [
        (1, sentence(1, 90) + " " + t["mit"] + " " + sentence(2, 30)),
        (2, " ".join(mit[:20] + ["changed"] + mit[21:]).upper()),
        (3, " ".join(mit[: len(mit) // 2])),
        (4, sentence(3, 13) + " Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (5, None), (6, ""), (7, sentence(9, 4000) + t["gpl-3.0-notice"]), (7, sentence(9, 4000) + t["gpl-3.0-notice"]),
    ]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("size", F.lit(1)).withColumn("license", F.lit(1))
    templates = licenses.default_templates(spark)
    got = licenses.scan(df, templates).collect()
    assert Counter((r["doc_id"], r["licenses"]) for r in got) == Counter([(1, "mit"), (2, "mit"), (3, ""), (4, "cc-by-nc-4.0-line,mit-line"), (5, ""), (6, ""), (7, "gpl-3.0-notice"), (7, "gpl-3.0-notice")])
    assert licenses.scan(nothing, templates).collect() == []
    assert {r["n_licenses"] for r in licenses.scan(docs, templates.where("false")).collect()} == {0}
    assert Counter(r["doc_id"] for r in licenses.scan(docs, templates).collect()) == Counter(i for i, _ in TEXTS)


def test_licenses_that_share_a_window(spark):
    """Three and four licences of one size class in one window, in every order and at several places."""
    lines = {n: licenses.TEMPLATES[n] for n in ("apache-2.0-line", "cc-by-nc-4.0-line", "gpl-3.0-line")} | {"own-line": "Distributed under the terms of the Own License."}
    templates = spark.createDataFrame(sorted((licenses.TEMPLATES | lines).items()), "license_id string, text string")
    assert {r["size"] for r in licenses.template_shingles(templates, "license_id", "text").where(F.col("license").isin(list(lines))).collect()} == {16}
    cases = [(order, at) for k in (3, 4) for order in itertools.permutations(lines, k) for at in (0, 5)]
    texts = [(i, " ".join([sentence(i, at)] * (at > 0) + [lines[n] for n in order])) for i, (order, at) in enumerate(cases)]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), templates).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: ",".join(sorted(order)) for i, (order, _) in enumerate(cases)}


def brute_licenses(text, templates):
    """Licences of which some window of their size class holds 80 % of the distinct shingles."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, found = cut(text), set()
    for name, template in templates.items():
        t = cut(template)
        m, size = min(5, len(t)), max(8, 1 << (math.ceil(len(t) * 1.25) - 1).bit_length())
        whole = {tuple(t[k : k + m]) for k in range(len(t) - m + 1)}
        for k in range(-(-len(words) // size)):
            held = {tuple(words[p : p + m]) for p in range(k * size, min((k + 2) * size, len(words) - m + 1))}
            if len(held & whole) / len(whole) >= 0.8:
                found.add(name)
    return ",".join(sorted(found))


def test_licenses_in_crowded_windows_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    templates = {f"t{k}": " ".join(rng.choices(vocabulary, k=rng.randint(5, 28))) for k in range(60)} | {"same": "a a a a a a a a a a a a", "two": "x y"}
    texts = []
    for i in range(250):
        parts = []
        for name in rng.choices(sorted(templates), k=rng.randint(1, 12)):
            w = templates[name].split()
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = "changed"
            parts += w + rng.choices(vocabulary, k=rng.choice([0, 0, 1, 7]))
        texts.append((i, " ".join(parts)))
    got = licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5), spark.createDataFrame(sorted(templates.items()), "license_id string, text string"))
    assert {r["doc_id"]: r["licenses"] for r in got.collect()} == {i: brute_licenses(t, templates) for i, t in texts}


def test_bands_miss_with_the_stated_probability():
    for size, lengths, least in ((8, [5], 1), (16, [5], 3), (256, [2, 5], 98)):
        widest = sum(2 * size - m + 1 for m in lengths)
        j = 0.8 * least / (widest + 0.2 * least)
        assert (1 - j) ** licenses.bands_of(size, lengths, least) <= licenses.MISS < (1 - j) ** (licenses.bands_of(size, lengths, least) - 2)


def test_licenses_need_the_whole_text(spark):
    """The opening under other terms is no match, and BSD-3-Clause is not the same as BSD-2-Clause."""
    t, other = licenses.TEMPLATES, sentence(5, 80)
    cut = {"mit": "THE SOFTWARE IS PROVIDED", "isc": "THE SOFTWARE IS PROVIDED", "bsd-2-clause": "THIS SOFTWARE IS PROVIDED", "unlicense": "In jurisdictions"}
    texts = [(f"{k} cut", t[k].split(v)[0] + other) for k, v in cut.items()] + [(k, t[k]) for k in cut]
    head, tail = t["bsd-2-clause"].split(cut["bsd-2-clause"])
    texts += [("bsd-3-clause", head + t.get("bsd-3-clause-endorsement", "") + " " + cut["bsd-2-clause"] + tail)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id string, text string"), licenses.default_templates(spark)).collect()}
    assert got == {f"{k} cut": "" for k in cut} | {k: k for k in cut} | {"bsd-3-clause": "bsd-2-clause,bsd-3-clause-endorsement"}


# The queries and the pipeline


def test_queries_with_sql(spark):
    import duckdb

    from ruleweave.llm.queries import ORACLE, QUERIES

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, folder)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert multiset(df.select(*names).collect()) == Counter(tuple(r) for r in cursor.fetchall()), name


def test_stages_begin_with_heaps_given_back(spark, docs):
    import corpus_pipeline

    def whole_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))

    for _, stage in corpus_pipeline.STAGES[2:3] + corpus_pipeline.STAGES[4:]:
        before = whole_collections()
        stage(spark, docs.withColumn("n_chars", F.length("text")), "")
        assert whole_collections() > before


def test_pipeline(spark, library):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == before.columns
        if name == "language_id":
            assert docs.count() >= 0.99 * before.count()
        if name == "simhash_near_dedup":
            kept = [brute_fingerprint(r["text"]) for r in docs.collect()]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(kept) for b in kept[:i])
        if name == "suffix_array_dedup":
            seen = defaultdict(set)
            for r in docs.collect():
                words = r["text"].split()
                for k in range(len(words) - 50):
                    seen[" ".join(words[k : k + 51])].add(r["doc_id"])
            assert docs.count() == before.count() and all(len(s) == 1 for s in seen.values())
    final = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert final == {r["doc_id"]: len(library.encode(r["text"])) for r in docs.collect()}


def test_nothing_else_imports_the_operators():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "ruleweave")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "ruleweave.llm" not in open(os.path.join(folder, n)).read()
