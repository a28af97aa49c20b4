"""Packing, word pieces and sentence pieces: exact ids, exact round trips, brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import packing, sentencepieces, wordpiece
from lumenspan.llm.common import read
from lumenspan.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello, World's 123 ½ café", "don't we'll '", "it's<|endoftext|>x", "日本語 Ωσ Σ", "İstanbul", "a b c\x1cd", "!!??''s", "x" * 5000, "ǅ ß ŉ", "é", "퟿"]


@pytest.fixture(scope="module")
def word_bpe():
    return tokenizer_file("word_bpe_49k.json")


def test_ids_equal_the_library(word_bpe, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_bpe)
    texts = TEXTS + [r["text"] for r in read(spark, SF, "documents").limit(60).collect()]
    want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert packing.document_ids(word_bpe)(texts) == want


def plain_best_fit(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            best = min(fits, key=lambda b: b[0])
        else:
            bins.append(best := [size, []])
        best[0] -= x
        best[1].append(x)
    return sorted(tuple(b[1]) for b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 32, 100])
    lengths = [rng.randint(1, size) if rng.random() < 0.7 else rng.randint(1, 1 + size // 5) for _ in range(rng.choice([0, 1, 50, 400]))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    bins: dict = {}
    for r in packing.best_fit_decreasing(histogram, size):
        for k in range(r.count):
            bins.setdefault(r.bin + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    for spots in bins.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= size
    # Equally full bins may change places, so contents may differ where fillings don't.
    assert sorted(sum(n for _, n in s) for s in bins.values()) == sorted(map(sum, plain_best_fit(lengths, size)))


def test_tree_finds_the_tightest():
    rng = random.Random(1)
    tree, have = packing.CapacityTree(100), set()
    for _ in range(2000):
        c = rng.randint(0, 100)
        tree.set(c, c not in have)
        have ^= {c}
        want = rng.randint(0, 100)
        assert tree.tightest(want) == min((x for x in have if x >= want), default=None)


def test_pack(spark, word_bpe):
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "z " * 30_000)], "doc_id long, text string")
    docs = read(spark, SF, "documents").select("doc_id", "text").unionByName(odd).withColumn("length", F.lit("x")).withColumn("piece", F.lit(9))
    got = packing.pack(docs, word_bpe).collect()
    encode = packing.document_ids(word_bpe)
    want = sorted((str(r["doc_id"]), n, at // 4, len(c) // 4, zlib.crc32(c)) for r in docs.collect() for b in encode([r["text"]]) for n, at in enumerate(range(0, len(b), 8192)) for c in [b[at : at + 8192]])
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in bins.values():
        assert [o for o, _ in sorted(spots)] == list(np.cumsum([0] + [n for _, n in sorted(spots)])[:-1]) and sum(n for _, n in spots) <= 2048
    assert len(bins) == len(plain_best_fit([r["length"] for r in got], 2048))
    assert packing.pack(docs.limit(0), word_bpe).count() == 0


def greedy(word, pieces, longest):
    word, at, n = word + b"\xff", 0, 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(60))
def test_automaton_equals_greedy_matching(seed):
    rng = random.Random(seed)
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) + (b"\xff" if rng.random() < 0.4 else b"") for _ in range(rng.randint(1, 10))]
    words = [bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(0, 12))) for _ in range(50)]
    assert wordpiece.LongestMatch(pieces).count(words).tolist() == [greedy(w, set(pieces), 7) for w in words]


@pytest.mark.parametrize("seed", range(20))
def test_long_words_are_read_alike(seed, monkeypatch):
    rng = random.Random(seed)
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) + (b"\xff" if rng.random() < 0.4 else b"") for _ in range(rng.randint(1, 14))]
    words = [bytes(rng.choice(b"abcd" if rng.random() < 0.02 else b"abc") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    both = wordpiece.LongestMatch(pieces)
    want = [greedy(w, set(pieces), 7) for w in words]
    assert both.count(words).tolist() == want
    monkeypatch.setattr(wordpiece, "LONG", -1)
    assert both.count(words).tolist() == want


def test_unbroken_text_is_quick(word_bpe, unigram):
    """A megabyte without white space, in letters of several scripts; the check is on CPU time and far off what it takes."""
    import time

    rng = random.Random(1)
    for letters in ("etaoinshrdlu", "".join(map(chr, range(0x4E00, 0x4F00))), "".join(map(chr, range(0xE01, 0xE2F)))):
        text = "".join(rng.choice(letters) for _ in range((1 << 20) // len(letters[0].encode())))
        began = time.process_time()
        words, tokens = wordpiece.worker_counter(word_bpe)([text])
        counted = time.process_time()
        ids = unigram.encode([text])[0]
        assert time.process_time() - counted < 10 and counted - began < 10
        assert words == [1] and tokens[0] > 1000 and unigram.decode(ids) == text


def test_token_counts(spark, word_bpe):
    import regex

    pieces = set(wordpiece.load_pieces(word_bpe))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (0, "again")], "doc_id long, text string").withColumn("n_words", F.lit("x"))
    docs = docs.unionByName(read(spark, SF, "documents").limit(20).select("doc_id", "text", F.lit("x").alias("n_words")))
    got = sorted(map(tuple, wordpiece.token_counts(docs, word_bpe).collect()), key=str)
    words = lambda t: regex.findall(r"[\p{L}]+|[\p{N}]|[^\x20\t\n\v\f\r\p{L}\p{N}]+", (t or "").lower())
    want = sorted(((r["doc_id"], len(words(r["text"])), sum(greedy(w.encode(), pieces, 70) for w in words(r["text"]))) for r in docs.collect()), key=str)
    assert got == want
    assert wordpiece.token_counts(docs.limit(0), word_bpe).count() == 0


@pytest.fixture(scope="module")
def unigram():
    return sentencepieces.Unigram(sentencepieces.load_pieces(tokenizer_file("piece_bpe_32k.model")))


def plain_viterbi(model, text):
    """Best total score over all segmentations of the marked text, one position at a time."""
    data = (" " + text).replace(" ", sentencepieces.MARK)
    score = {t.decode(): s for t, s in zip(model.pieces.texts, model.pieces.scores, strict=True) if t}
    best = [0.0] + [-np.inf] * len(data)
    for i in range(len(data)):
        for j in range(i + 1, min(len(data), i + 48) + 1):
            if data[i:j] in score:
                best[j] = max(best[j], best[i] + score[data[i:j]])
        if data[i] not in score:
            best[i + 1] = max(best[i + 1], best[i] + model.unknown_score)
    return best[-1]


@pytest.mark.parametrize("text", ["hello world", "a  b", "  x ", "naïve 日本語 😀 ok", "tab\tnew\nline", " ", "it's 12345", "aaaaaaaaaaaa", "\n\n", "x" * 200])
def test_viterbi(unigram, text):
    ids = np.frombuffer(unigram.encode([text])[0], "<u4").tolist()
    pieces = unigram.pieces
    total, i = 0.0, 0
    while i < len(ids):
        if ids[i] in pieces.byte_ids:  # an unknown character's bytes
            first = int(np.flatnonzero(pieces.byte_ids == ids[i])[0])
            i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            total += unigram.unknown_score
        else:
            total += pieces.scores[ids[i]]
            i += 1
    assert total == pytest.approx(plain_viterbi(unigram, text), rel=1e-12)
    assert unigram.decode(unigram.encode([text])[0]) == text


def test_long_stretches_are_read_alike(unigram, monkeypatch):
    rng = random.Random(5)
    letters = "etaoin日本語ก😀é\x00"
    stretches = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))).encode() for _ in range(60)] + [b"", b"a", b"\xe3\x80"]
    monkeypatch.setattr(sentencepieces, "LONG", 1 << 30)
    together = unigram.segment(stretches)
    monkeypatch.setattr(sentencepieces, "LONG", -1)
    assert unigram.segment(stretches) == together


def test_decoding_equals_the_library(unigram):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for text in ("hello world", "naïve 日本語 😀 ok", "a  b"):
        ids = np.frombuffer(unigram.encode([text])[0], "<u4")
        assert model.decode(ids.tolist()) == unigram.decode(ids.tobytes())


def test_double_array():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab\xe3\x80") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = sentencepieces.DoubleArray(words)
    for i, w in enumerate(words):
        node = 0
        for b in w:
            nxt = trie.base[node] + b
            assert trie.check[nxt] == node
            node = nxt
        assert trie.value[node] == i


def plain_ids(model, text):
    """Ids of the best path by a plain program over characters; ties go to the piece that starts first."""
    if not text:
        return []
    data = (" " + text).replace(" ", sentencepieces.MARK)
    number = {t.decode(): i for i, t in enumerate(model.pieces.texts) if t}
    best, back = [0.0] + [-np.inf] * len(data), [None] * (len(data) + 1)
    for i in range(len(data)):
        for j in range(i + 1, min(len(data), i + 48) + 1):
            k = number.get(data[i:j])
            if k is not None and best[i] + model.pieces.scores[k] > best[j]:
                best[j], back[j] = best[i] + model.pieces.scores[k], (i, [k])
        if data[i] not in number and best[i] + model.unknown_score > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + model.unknown_score, (i, [int(model.pieces.byte_ids[b]) for b in data[i].encode("utf-8", "surrogatepass")])
    out, at = [], len(data)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_sentence_pieces_are_brute_force(spark, unigram):
    docs = read(spark, SF, "documents").limit(25).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_ids"], r["ids_crc32"], list(r["ids"])) for r in sentencepieces.sentence_pieces(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=True).collect()}
    for r in docs.collect():
        want = plain_ids(unigram, r["text"])
        assert got[r["doc_id"]] == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)


def test_sentence_pieces(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a ▁ b"), (0, "x")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_ids", F.lit(2))
    got = {(r["doc_id"], r["round_trip"]) for r in sentencepieces.sentence_pieces(docs, tokenizer_file("piece_bpe_32k.model")).collect()}
    assert got == {(i, True) for i in range(len(TEXTS))} | {(None, False)}
    assert sentencepieces.sentence_pieces(docs.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0
