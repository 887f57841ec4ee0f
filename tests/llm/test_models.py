import math
import random
import re
import zlib

import numpy as np
import xxhash
from callproof.llm import classifier, toxicity

DOCS = "doc_id long, text string, lang string, score double"


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(900):
        good = rng.random() < 0.7
        words = prose(rng, rng.randint(20, 60)).split()
        bad = rng.choice([[w + "!!" for w in words], [w.upper() for w in words], [w for w in words for _ in range(5)]])
        rows.append((k, " ".join(words if good else bad), "en", 0.5))
        labels.append((k, int(good), 0))
    rows += [(5000, "", "en", 0.0), (5001, None, None, None), (None, "some words", None, None), (5002, "word " * 100_000, "en", 0.0), (3, rows[3][1], "en", 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([*labels, (None, 1, 0), (7000, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out = classifier.classify(docs, known, "quality", classifier.remainder("doc_id", 3) == 1, classifier.remainder("label_id", 3) == 1)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(900))
    held = [k for k in range(900) if by_id[k]["held_out"]]
    assert np.mean([by_id[k]["predicted"] == labels[k][1] for k in held]) > 0.95
    none = classifier.classify(docs, known.limit(0), "quality", classifier.remainder("doc_id", 3) == 1, classifier.remainder("label_id", 3) == 1)
    assert {r["score"] for r in none.collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_read(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, prose(rng, 30), "en", 0.0) for k in range(200)], DOCS)
    held = [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(200)]
    run = lambda flip: {r["doc_id"]: r["score"] for r in classifier.classify(docs, spark.createDataFrame([(k, (k + (flip and held[k])) % 2) for k in range(200)], "doc_id long, quality int"), "quality", classifier.remainder("doc_id", 3) == 1, classifier.remainder("label_id", 3) == 1).collect()}
    assert run(False) == run(True)


def test_ftrl_learns_and_drops_idle_slots():
    rng = np.random.default_rng(0)
    rows = [(np.array([int(y), 2 + int(rng.integers(50))]), np.ones(2), y) for y in rng.integers(0, 2, 2000).tolist()]
    w, _ = classifier.ftrl(iter(rows), 64)
    assert w[1] > 1 > -1 > w[0] and not w[60:].any()


def lev(a, b):
    r = list(range(len(b) + 1))
    for i, x in enumerate(a):
        n = [i + 1]
        for j, y in enumerate(b):
            n.append(min(r[j] + (x != y), r[j + 1] + 1, n[j] + 1))
        r = n
    return r


def test_automata_equal_edit_distances():
    rng = random.Random(0)
    for _ in range(1500):
        entries = list({"".join(rng.choices("abc", k=rng.randint(2, 15))) for _ in range(5)})
        m = toxicity.Matcher(entries)
        word = "".join(rng.choices("abc", k=rng.randint(1, 18)))
        want = []
        for k, e in enumerate(m.trie.entries):
            r, most = lev(e, word), toxicity.edits_allowed(len(e))
            if min(r) <= most and (r[-1] <= most or 4 <= len(e) <= 12):
                want.append((k, r[-1] if r[-1] <= most else min(r), int(r[-1] > most)))
        assert sorted(m.all_matches(word)) == sorted(want)


def test_quotation():
    words = 'he wrote "you utter idiot" to her'.split()
    assert toxicity.quoted(words, 4) and not toxicity.quoted("you utter idiot go".split(), 2)


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(1500):
        words = prose(rng, rng.randint(20, 60)).split()
        bad = rng.random() < 0.15
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zwumpkin", "gragblob", "vormpel" + rng.choice(["s", "isch", "ung"])]))
        rows.append((k, " ".join(words), "en", 0.0))
        labels.append((k, 1, int(bad)))
    rows += [(5000, "", None, None), (5001, None, None, None), (None, prose(rng, 40), None, None), (5002, prose(rng, 20) + " you zwunpkin and gragbolb " + prose(rng, 20), "en", 0.0), (5003, prose(rng, 30_000), "en", 0.0), (7, rows[7][1], "en", 0.0)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(1500))
    held = [k for k in range(1500) if by_id[k]["held_out"]]
    assert np.mean([by_id[k]["predicted"] == labels[k][2] for k in held]) > 0.98
    assert by_id[5002]["predicted"] == 1 and not any(by_id[k]["predicted"] for k in (5000, 5001, 5003, None))
    kept = toxicity.kept_rows(docs, docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert {r["predicted"] for r in toxicity.toxicity(docs, known.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def test_ftrl_against_the_plain_rule():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(40, 5, replace=False)), rng.random(5), int(rng.integers(0, 2))) for _ in range(300)]
    z, n = [0.0] * 41, [0.0] * 41

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.1 + 0.1)

    for at, x, y in rows:
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (40, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
        for i, v in pairs:
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.1 * w[i]
            n[i] += g * g
    got, bias = classifier.ftrl(iter(rows), 40)
    assert np.allclose(got, [weight(i) for i in range(40)]) and math.isclose(bias, weight(40))


def plain_slots(text, bits):
    """The slots of a text's n-grams, one by one with whole numbers."""
    most, out = 2**64, []
    words = (text or "").encode().split()
    code = [xxhash.xxh64_intdigest(w.lower().rstrip(b".,;:!?"), 1) for w in words]
    form = [xxhash.xxh64_intdigest(classifier.shape(w), 2) if k == 0 or w != words[k - 1] else 0x9E3779B97F4A7C15 for k, w in enumerate(words)]
    for one, k in ((code, 0xC2B2AE3D27D4EB4F), (form, 0x165667B19E3779F9)):
        out += [*one, *((a * k + b) % most * 0x9E3779B97F4A7C15 % most for a, b in zip(one, one[1:], strict=False))]
    return [x * 0xD6E8FEB86659FD93 % most >> 64 - bits for x in out]


def test_quality_scores_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["", "one", "Two two", "a1-B2!? " + "Ab" * 40 + " Ab!", *(prose(rng, rng.randint(1, 80)) for _ in range(40))]
    weights = np.random.default_rng(2).normal(size=1 << 10).astype(np.float32)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: r["s"] for r in df.select("k", classifier.score_column(spark, weights, 0.3, 10)("text").alias("s")).collect()}
    for k, t in enumerate(texts):
        slots = plain_slots(t, 10)
        assert math.isclose(got[k], 1 / (1 + math.exp(-0.3 - classifier.SCALE * (sum(float(weights[i]) for i in slots) / len(slots) if slots else 0))), rel_tol=1e-4), t


def test_shapes_are_whole():
    assert classifier.shape(b"Ab-cD12!!") == b"Aa-aA0!!" and classifier.shape(b"x-" * 20) == b"a-" * 20 != classifier.shape(b"x-" * 19)


def test_toxicity_scores_against_brute_force(spark):
    rng = random.Random(11)
    entries = ["hag", "gragblob", "vormpel", "zwumpkinistically"]
    worth = {(k, e, part): 3.0 - e - 0.5 * part + 0.1 * k for k in range(4) for e in range(3) for part in range(2)}
    model = toxicity.Model(entries, worth, np.array([1.0, 0.5, -0.4, 0.3, 0.2, -0.6, -2.0]), frozenset(["said"]), frozenset(["you"]))
    bits = ["hag", "hags", "gragblob", "gragbolb", "Vormpelisch!", "vornpel", "zwumpkinistically", "zwumpkinisticaly", "zwumpkinisticallyness", "you", "said", '"oh', 'go"', "plain", "words"]
    texts = ["", None, *(" ".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(150))]

    def value(word):
        word = re.sub(r"^[\W_]+|[\W_]+$", "", word).lower()
        best = 0.0
        for k, e in enumerate(entries):
            row, most = lev(e, word), toxicity.edits_allowed(len(e))
            if not word or min(row) > most or (row[-1] > most and not 4 <= len(e) <= 12):
                continue
            best = max(best, worth.get((k, row[-1], 0) if row[-1] <= most else (k, min(row), 1), 0.0))
        return best

    def score(text):
        words, x = (text or "").split(), [0.0] * 6
        for k, w in enumerate(words):
            if v := value(w):
                around = {re.sub(r"^[\W_]+|[\W_]+$", "", u).lower() for u in words[max(0, k - 5) : k + 6]}
                kind = 2 if toxicity.quoted(words, k) or "said" in around else 0 if "you" in around else 1
                x[kind], x[3 + kind] = max(x[kind], v), x[3 + kind] + v
        return 1 / (1 + math.exp(2.0 - sum(a * b for a, b in zip(model.weights, [*x[:3], *map(math.log1p, x[3:])], strict=False))))

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: r["s"] for r in df.select("k", toxicity.score_column(spark, model)("text").alias("s")).collect()}
    assert all(math.isclose(got[k], score(t), abs_tol=1e-9) for k, t in enumerate(texts))


def test_words_of_any_length_can_be_entries(spark):
    rng = random.Random(12)
    rows = []
    for k in range(600):
        bad = k % 6 == 0
        words = prose(rng, 30).split() + ([rng.choice(["zog", "qwerzumpelantischerweise"])] if bad else []) + prose(rng, 5).split()
        rows.append((" ".join(words), int(bad)))
    counts = toxicity.word_counts(spark.createDataFrame(rows, "text string, y int"))
    assert {"zog", "qwerzumpelantischerweise"} & {*toxicity.lexicon(counts, 1 / 6)} and "zog" in toxicity.lexicon(counts, 1 / 6)
