"""Language identification, toxicity and quality rules: held-out accuracy, exact bounds, odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import langid, quality, toxicity
from lumenspan.llm.common import read

SF = "/root/testdata/sf0.01"
ODD = [(None, "ein text ohne id", "de", 1), (1, None, "en", 2), (2, "", "en", 3), (3, "123 !?", "en", 4), (4, "w" * 50_000, None, 5), (4, "w" * 50_000, None, 5)]
ODD_SCHEMA = "doc_id long, text string, lang string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return read(spark, SF, "labels").cache()


def test_language_accuracy(docs):
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)


def test_language_ignores_labels_of_held_out_rows(docs):
    held = ~langid.learn_rows()
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(langid.language_id(other).collect(), key=str) == sorted(langid.language_id(docs).collect(), key=str)


def test_lookup_tables_equal_convolution():
    net = langid.ByteNet(["a", "b"])
    rows = np.random.default_rng(1).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    pooled, _ = net._pooled(rows)
    plain = np.maximum(pooled + net.weights["bias"], 0) @ net.weights["out"] + net.weights["out_bias"]
    assert np.allclose(net.freeze().predict(rows), plain, atol=1e-4)


def test_prediction_is_brute_force():
    """Language and score of whole texts by plain code: windows, convolution at every place, maximum, softmax, mean."""
    net = langid.ByteNet(["a", "b", "c"]).freeze()
    texts = ["Hello there, " * 60, "ÄÖ ß " * 3, "x", "日本語" * 200, None, "", "12 !"]

    def plain(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        data = text.lower().encode()
        data += b" " * (-len(data) % langid.WINDOW)
        total, weights = np.zeros(3), 0.0
        for low in range(0, len(data), langid.WINDOW):
            row = data[low : low + langid.WINDOW]
            pooled = []
            for w in langid.WIDTHS:
                kernel = net.weights[f"filter{w}"]
                pooled.append(np.max([sum(net.weights["embed"][row[p + k]] @ kernel[k] for k in range(w)) for p in range(langid.WINDOW - w + 1)], 0))
            logits = (np.maximum(np.concatenate(pooled) + net.weights["bias"], 0) @ net.weights["out"] + net.weights["out_bias"]).astype(float)
            weight = sum(b > 32 for b in row) + 1e-9
            total += weight * (logits - logits.max() - np.log(np.exp(logits - logits.max()).sum()))
            weights += weight
        p = np.exp(total / weights - (total / weights).max())
        return net.languages[int(p.argmax())], float((p / p.sum()).max())

    got = list(zip(*langid.predict_texts(net, texts), strict=True))
    for (a, x), (b, y) in zip(got, map(plain, texts), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-4)


def test_language_ties_go_to_the_first():
    net = langid.ByteNet(["b", "c"]).freeze()
    net.weights["out"][:], net.weights["out_bias"][:] = 0, 0
    assert langid.predict_texts(net, ["some text"]) == (["b"], [0.5])


def test_nothing_learnt_keeps_nothing_quietly(spark, docs):
    with pytest.raises(ValueError):
        langid.keep_known(docs.withColumn("lang", F.lit(None).cast("string")))
    assert langid.keep_known(docs.limit(0)).count() == 0


def test_language_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = langid.language_id(docs.select("doc_id", "text", "lang").withColumn("n_words", F.lit(0)).unionByName(odd).withColumn("lang_pred", F.lit(1)))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count() + len(ODD)
    assert got.where("doc_id is null").first()["lang_pred"] in {"de", "en", "es", "fr"}
    alone = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(odd.where("lang is null or text is null")).collect()}
    assert alone[1] == ("und", 0.0)
    assert langid.language_id(docs.limit(0)).count() == 0


def test_toxicity_held_out(spark, docs, labels):
    big, known = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.toxicity(big, known).join(known, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    # Seven of the 97 toxic documents hold no insult at all.
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.87 and sum(r["predicted"] for r in clean) / len(clean) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def invented(n, seed=0):
    """(document, label, sentence) rows; toxic documents have three sentences, one of which holds an insult."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeiournst"), 6))
    rows = []
    for i in range(n):
        for k in range(3):
            bad = i % 2 and k == i % 3
            rows.append((i, i % 2, f"{word()} {word()} {['grotmuk', 'blixdar'][i // 2 % 2] if bad else word()} {word()}."))
    return rows


def test_toxicity_tolerates_gaps():
    model = toxicity.fit(invented(400))
    said = model.values(["grotmuk", "gro-tmuk", "grotxmuk", "grot", "blixdar", "rainstone", "sun"]) + model.bias
    assert (said[:2] > 0.5).all() and said[2] > -0.7 and said[4] > 0.5 and (said[5:] < -0.5).all()
    assert model.margins([toxicity.units("so g r o t m u k it is")])[0] > 0.5


def test_machine_learns_from_sentences():
    """Clean sentences of toxic documents end up on the clean side, though their label said toxic."""
    model, rows = toxicity.fit(invented(400)), invented(200, 1)
    margin = model.margins([sorted(set(toxicity.units(s))) for _, _, s in rows])
    bad = np.array(["grotmuk" in s or "blixdar" in s for _, _, s in rows])
    assert (margin[bad] > 0).mean() > 0.98 and (margin[~bad] < 0).mean() > 0.9
    assert toxicity.fit([r for r in rows if r[1]]) is None and toxicity.fit([]) is None


def plain_features(unit):
    """Normalised counts of gapped triples, piece by piece."""
    out = []
    rows, long, _ = toxicity._pieces([unit])
    for codes in (r[:n].tolist() for r, n in zip(rows, long, strict=True)):
        count: dict = {}
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + toxicity.SPAN)):
                    key = (codes[i], codes[j], codes[k])
                    count[key] = count.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        norm = math.sqrt(sum(v * v for v in count.values()))
        out.append({k: v / norm for k, v in count.items()})
    return out


def test_long_units_are_overlapping_pieces():
    codes, long, owner = toxicity._pieces(["b" * 60, "", "ab"])
    assert owner.tolist() == [2, 0, 0, 0, 0, 0] and long.tolist() == [4, 24, 24, 24, 24, 14] and codes[0, :4].tolist() == [126, 1, 2, 127]
    assert codes[1, 0] == 126 and (codes[2] == 2).all() and codes[5, 13] == 127


@pytest.mark.parametrize("unit", ["banana", "a", "aaaaaaaa", "über", "x" * 60, "日本語"])
def test_kernel_is_subsequence_count(unit):
    codes, long, owner = toxicity._pieces([unit, "!", unit])
    assert owner.tolist().count(0) == owner.tolist().count(2) == len(codes) / 2
    pieces = codes[owner == 0]
    rows, cols, vals = toxicity.features(pieces, long[owner == 0])
    n = toxicity.ALPHABET
    got = [{(c // n // n, c // n % n, c % n): v for c, v in zip(cols[rows == k].tolist(), vals[rows == k], strict=True)} for k in range(len(pieces))]
    want = plain_features(unit)
    assert [g.keys() for g in got] == [w.keys() for w in want] and all(g[k] == pytest.approx(w[k]) for g, w in zip(got, want, strict=True) for k in w)


def test_score_is_brute_force():
    """A document's score by plain code: sentences, units, kernel values, the three largest margins, the logistic curve."""
    rows = invented(60)
    model = toxicity.fit(rows, landmarks=24)
    texts = [None, "", "...", "Grotmuk! you g r o t m u k", "rain " * 200, " ".join(s for _, _, s in rows[:9]), "one\ntwo blixdar\nthree. four"]
    names: dict = {}
    for _, _, s in rows:
        names.update(dict.fromkeys(toxicity.units(s)))
    marks = model.landmarks

    def value(unit):
        return sum(sum(w * k for w, k in zip(model.weights, marks.kernel(c[None], n[None])[0], strict=True)) for c, n, _ in zip(*toxicity._pieces([unit]), strict=True))

    def plain(text):
        found = []
        for s in toxicity.SENTENCE.findall(text or ""):
            while len(s) > toxicity.SENTENCE_CHARS:
                at = s.rfind(" ", toxicity.SENTENCE_CHARS // 2, toxicity.SENTENCE_CHARS)
                at = at if at > 0 else toxicity.SENTENCE_CHARS
                found.append(s[:at])
                s = s[at:]
            found.append(s)
        margins = [sum(value("".join(c for c in u if c.isalpha())) for u in set(toxicity.units(s))) + model.bias for s in found if toxicity.units(s)]
        top = [*sorted(margins, reverse=True)[: toxicity.TOP], *[-1.0] * toxicity.TOP][: toxicity.TOP]
        at = sum(c * min(2, max(-2, t)) for c, t in zip(model.curve, top)) + model.curve[-2] * math.log1p(len(margins)) + model.curve[-1]
        return 1 / (1 + math.exp(-at))

    assert toxicity.score_texts(model, {}, texts) == pytest.approx([plain(t) for t in texts])


def test_landmark_kernel_is_the_cosine():
    units = ["grotmuk", "gromuk", "banana", "ananas", "x" * 20]
    marks = toxicity.Landmarks(*toxicity._pieces(units[:3])[:2])
    got = marks.kernel(*toxicity._pieces(units)[:2])
    each = [plain_features(u)[0] for u in units]
    want = [[sum(v * b.get(k, 0) for k, v in a.items()) ** toxicity.POWER for b in each[:3]] for a in each]
    assert np.allclose(got, want)


def test_toxicity_odd_rows(spark, docs, labels):
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = toxicity.toxicity(docs.select("doc_id", "text", "lang").withColumn("n_words", F.lit(0)).unionByName(odd).withColumn("score", F.lit("x")).withColumn("labelled", F.lit(1)).withColumn("label", F.lit(1)).withColumn("_toxic", F.lit(1)), labels)
    assert got.count() == docs.count() + len(ODD) and got.where("score is null").count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def plain_counts(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", "a", "a b c a b c a b c", "x # y\nx # y\n\n \nz q <|>", "a a a a", "é ü ß 日本 😀\na\na\nb\na", "one two three four one two three"])
def test_base_counts(text):
    assert quality.base_counts(text)[:5] == plain_counts(text)


def test_base_counts_on_documents(docs):
    for r in docs.where("length(text) < 3000").limit(200).collect():
        assert quality.base_counts(r["text"])[:5] == plain_counts(r["text"])


def test_bound_is_exact():
    for n, k in ((50, 0), (200, 3), (1000, 9)):
        for alpha in (0.01, 0.05, 0.1):
            tail = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
            for delta in (1e-3, 0.05, 0.5):
                assert quality.within_bound(k, n, alpha, delta) == (tail <= delta)
    assert not quality.within_bound(0, 0, 0.1, 0.5)


def test_walk_stops_at_first_failure():
    grid = {r: [0] * len(g) for r, g in quality.GRIDS.items()}
    grid["symbol_share"][3] = 900
    got = quality.certify({("en", r): v for r, v in grid.items()}, {"en": 5000})
    assert got["en", "symbol_share"] == quality.GRIDS["symbol_share"][2]
    assert quality.certify({("xx", r): [0] * len(g) for r, g in quality.GRIDS.items()}, {"xx": 10}) == {}


def test_small_strata_walk_jointly():
    none = {("es", r): [0] * len(g) for r, g in quality.GRIDS.items()}
    clean = [0] * len(quality.JOINT)
    assert quality.certify(none, {"es": 297, "a": 1, "b": 1, "c": 1}, joint=dict.fromkeys(["es", "a", "b", "c"], clean)) == {("es", r): g[-1] for r, g in quality.GRIDS.items()}
    assert quality.certify(none, {"es": 100}, joint={"es": clean}) == {}
    stop = quality.JOINT.index(("long_word", 18.0))
    got = quality.certify(none, {"es": 400}, joint={"es": [0] * stop + [9] * (len(clean) - stop)})
    assert got["es", "long_word"] == 20.0 and set(got) == set(none)
    mild = {r: c for r, c in quality.JOINT[:stop]}
    assert got == {("es", r): c for r, c in mild.items()}


def test_joint_steps_count_what_rules_reject_together(spark):
    rows = spark.createDataFrame([(100, 400, 5, 0, 0, 0, 1), (100, 1900, 120, 0, 0, 55, 1), (100, 500, 0, 0, 0, 0, 1)], ", ".join(f"{c} long" for c in (*quality.COUNTS, "n_lines")))
    columns = rows.select(quality.first_step().alias("s"), *[v.alias(r) for r, v in quality.features().items()]).collect()
    want = [next((i for i, (rule, c) in enumerate(quality.JOINT) if r[rule] > c), len(quality.JOINT)) for r in columns]
    assert [r["s"] for r in columns] == want and len(set(want)) == 3


def test_every_language_of_sf01_has_cutoffs(spark):
    big, known = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    cutoffs = quality.fit(quality.counted(big, keep=("lang",)), known)
    assert {s for s, _ in cutoffs} >= {"de", "en", "es", "fr"}


def plain_cutoffs(rows, good):
    """Certified cutoffs by the definition, from (stratum, features) of labelled good rows."""
    held: dict = {}
    for stratum, values in rows:
        held.setdefault(stratum, []).append(values)
    held = {s: v for s, v in held.items() if (1 - quality.ALPHA) ** len(v) <= quality.DELTA}
    out, walks = {}, max(1, len(held) * len(quality.GRIDS))

    def fine(k, n, alpha):
        return k < n and sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) <= quality.DELTA / walks

    for s, docs_ in held.items():
        n = len(docs_)
        if fine(0, n, quality.ALPHA / len(quality.GRIDS)):
            for rule, grid in quality.GRIDS.items():
                for c in grid:
                    if not fine(sum(d[rule] > c for d in docs_), n, quality.ALPHA / len(quality.GRIDS)):
                        break
                    out[s, rule] = c
        else:
            own: dict = {}
            for rule, c in quality.JOINT:
                own[rule] = c
                if not fine(sum(any(d[r] > x for r, x in own.items()) for d in docs_), n, quality.ALPHA):
                    break
                out[s, rule] = c
    return out


def test_kept_is_brute_force(spark):
    """The verdict on every row of sf0.1, by plain counts, plain cutoffs and plain comparisons."""
    big, known = read(spark, "/root/testdata/sf0.1", "documents").where("length(text) < 4000"), read(spark, "/root/testdata/sf0.1", "labels")
    good = {r["doc_id"] for r in known.where("quality = 1").collect()}
    rows = {}
    for r in big.select("doc_id", "lang", "text").collect():
        words, chars, symbols, dup, repeat = plain_counts(r["text"]) if len(r["text"]) < 1500 else quality.base_counts(r["text"])[:5]
        shouts = sum(w.isupper() and len(w) > 1 for w in r["text"].encode().split())
        n = max(1, words)
        values = {"symbol_share": symbols / n, "repeat_share": repeat / n, "dup_line_share": dup / max(1, r["text"].count("\n") + 1), "long_word": chars / n, "shout_share": shouts / n}
        rows[r["doc_id"]] = (r["lang"], values, words < quality.MIN_WORDS or 100 * repeat > quality.REPEAT_PERCENT * words)
    cutoffs = plain_cutoffs([(s, v) for i, (s, v, failed) in rows.items() if i in good and not failed], good)
    want = {i: not failed and not any(v[rule] > cutoffs.get((s, rule), math.inf) for rule in v) for i, (s, v, failed) in rows.items()}
    assert len({s for s, _ in cutoffs}) >= 2
    assert {r["doc_id"]: r["kept"] for r in quality.assess(big, known).collect()} == want


def test_false_rejections_stay_under_alpha():
    """Cutoffs from 400 holdouts drawn 300 times: in at most a DELTA of the draws (and some luck) over ALPHA of the population is rejected."""
    rng = np.random.default_rng(6)
    values = {"symbol_share": rng.exponential(0.03, 40_000), "repeat_share": rng.beta(1, 12, 40_000), "dup_line_share": rng.beta(1, 20, 40_000), "long_word": rng.normal(6, 1.5, 40_000), "shout_share": rng.exponential(0.02, 40_000)}
    step = np.full(40_000, len(quality.JOINT))
    for i, (rule, c) in reversed([*enumerate(quality.JOINT)]):
        step = np.where(values[rule] > c, i, step)
    bad = 0
    for _ in range(300):
        pick = rng.integers(0, 40_000, 400)
        joint = {"x": [int((step[pick] <= i).sum()) for i in range(len(quality.JOINT))]}
        got = quality.certify({("x", r): [int((values[r][pick] > c).sum()) for c in g] for r, g in quality.GRIDS.items()}, {"x": 400}, joint=joint)
        bad += np.any([values[r] > c for (_, r), c in got.items()], axis=0).mean() > quality.ALPHA if got else 0
    assert bad <= 300 * quality.DELTA + 8


def test_quality_on_documents(spark, docs, labels):
    big, known = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    got = quality.assess(big, known)
    assert got.count() == big.count() and got.where("base_failed and kept").count() == 0
    good = got.join(known.where("quality = 1"), "doc_id").where("not base_failed")
    assert good.where("kept").count() / good.count() > 1 - quality.ALPHA
    kept = quality.keep_good(big, known)
    assert kept.columns == big.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in got.where("kept").select("doc_id").collect()}


def test_quality_odd_rows(spark, labels):
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = quality.assess(odd, labels)
    assert got.count() == len(ODD) and got.where("kept").count() == 0
    assert quality.keep_good(odd, labels).count() == 0 and quality.keep_good(odd, labels).columns == odd.columns
    assert quality.assess(odd.limit(0), labels.limit(0)).count() == 0
