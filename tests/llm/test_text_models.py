import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewick.llm import language_id, ngram_perplexity, quality_classifier
from candlewick.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
EDGE = [None, "", " \n\t", "a", "...", "12 34", "Ünïcode ß 漢字 😀 text", "line\nline\n\nline \nline", " x " * 30, "one two three four five six seven eight nine " * 3, "#*$%&|<>", "\x00 \x1c\x85 b"]


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def symbols(text):
    """Code points in lower case below 65536, a space after each word."""
    out = []
    for w in WORD.findall(text or ""):
        out += [(ord(c.lower()[0]) if ord(c) < 0x10000 else ord(c)) or 0x10FFFF for c in w]
        out.append(32)
    return out


class Plain:
    """Modified Kneser-Ney of order 5 with dictionaries."""

    ORDER = 5

    def __init__(self, texts):
        grams = Counter()
        for t in texts:
            grams.update(self.grams(t))
        self.counts = {self.ORDER: grams}
        for o in range(self.ORDER - 1, 0, -1):
            self.counts[o] = Counter(g[1:] for g in self.counts[o + 1])
        self.d, self.total, self.kinds = {}, {}, {}
        for o, c in self.counts.items():
            n = [sum(v == i for v in c.values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            self.d[o] = [0] + [min(i, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
            self.total[o], self.kinds[o] = Counter(), defaultdict(float)
            for g, v in c.items():
                self.total[o][g[:-1]] += v
                self.kinds[o][g[:-1]] += self.d[o][min(v, 3)]

    def grams(self, text):
        s = [32] * (self.ORDER - 1) + symbols(text)
        return [tuple(s[i : i + self.ORDER]) for i in range(len(s) - self.ORDER + 1)]

    def p(self, g):
        if not g:
            return 1 / (len(self.counts[1]) + 1)
        o, h = len(g), g[:-1]
        v = self.counts[o][g]
        if not self.total[o][h]:
            return self.p(g[1:])
        return (v - self.d[o][min(v, 3)]) / self.total[o][h] + self.kinds[o][h] / self.total[o][h] * self.p(g[1:])

    def log_ppl(self, text):
        logs = [np.log(self.p(g)) for g in self.grams(text)]
        return -float(np.mean(logs)) if logs else None


def middle(values):
    return sorted(values)[(len(values) + 1) // 2 - 1]


def plain_band(values):
    """Median and the deviations of either side, on bins of a thousandth."""
    bins = [int(np.floor(v * 1000 + 0.5)) for v in values]
    mid = middle(bins)
    return mid / 1000, *(max(1.4826 * middle([abs(b - mid) for b in side]) / 1000, 0.01) for side in ([b for b in bins if b <= mid], [b for b in bins if b >= mid]))


def place(x, mid, below, above):
    return (x - mid) / (below if x < mid else above)


def test_rules_against_brute_force(spark):
    texts = [*EDGE, *(r["text"] for r in table(spark, SMALL, "documents").limit(60).collect())]
    rows = [(i if i else None, t, None if i % 5 == 0 else "ab"[i % 2], i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, log_ppl int").repartition(3)
    got = ngram_perplexity.rule(docs).collect()
    assert len(got) == len(rows) + 3
    every = rows + rows[:3]
    models = {k: Plain([r[1] for r in every if (r[2] or "und") == k]) for k in ("a", "b", "und")}
    pooled = Plain([r[1] for r in every])
    failed = lambda n, *_, repeated=0: n < 20 or 100 * repeated > 30 * n
    facts = [(r[2] or "und", models[r[2] or "und"].log_ppl(r[1]), pooled.log_ppl(r[1]), failed(base(r[1])[0], repeated=base(r[1])[4])) for r in every]
    good = [f for f in facts if not f[3] and f[1] is not None]
    own = {k: plain_band([f[1] for f in good if f[0] == k]) for k in models if any(f[0] == k for f in good)}
    whole, number = plain_band([f[2] for f in good]), Counter(f[0] for f in good)
    mine = {r["doc_id"]: r for r in got}
    for (i, text, _, _), (lang, log_ppl, among, bad) in zip(rows, facts, strict=False):
        r = mine[i]
        assert tuple(r[c] for c in ngram_perplexity.STATS) == base(text), text
        assert r["base_failed"] == bad and r["lang"] == lang
        assert (r["perplexity"] is None) == (log_ppl is None)
        if log_ppl is None:
            assert not r["kept"]
            continue
        assert r["perplexity"] == pytest.approx(np.exp(log_ppl), rel=1e-9)
        n = number[lang]
        want = (n * (place(log_ppl, *own[lang]) if n else 0) + 50 * place(among, *whole)) / (n + 50)
        assert r["distance"] == pytest.approx(want, rel=1e-6, abs=1e-6) and r["kept"] == (not bad and -3 <= want <= 4)
    assert any(r["kept"] for r in got) and any(not r["kept"] and not r["base_failed"] for r in got)
    joined = {r["doc_id"]: r for r in ngram_perplexity.rule(docs, sent=0).collect()}
    for i, r in mine.items():
        assert all(r[c] == pytest.approx(joined[i][c], rel=1e-9, abs=1e-9) if isinstance(r[c], float) else r[c] == joined[i][c] for c in r.asDict())
    assert ngram_perplexity.rule(docs.limit(0)).count() == 0


def test_texts_that_were_not_counted(spark):
    """Unseen n-grams, contexts, symbols and languages; a model counted on nothing; both ways to look n-grams up."""
    known = [("the sea was calm and then night came", "a"), ("漢字 and the sea", "a"), ("la mer est calme", "b"), ("кот и пёс", None)]
    asked = [*EDGE, "the sea was calm", "qqq zzz", "кот sea mer 漢", "😀😀 the", "x" * 3000]
    rows = [(i, t, (None, "a", "b", "elsewhere")[j]) for j in range(4) for i, t in enumerate(asked, 100 * j)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ngram_perplexity.fit(spark.createDataFrame(known, "text string, lang string"))
    plain = {k: Plain([t for t, x in known if (x or "und") == k]) for k in ("a", "b", "und")}
    pooled = Plain([t for t, _ in known])
    for sent in (ngram_perplexity.SENT, 0):
        got = {r["doc_id"]: r for r in ngram_perplexity.measure(docs, model, sent).collect()}
        assert len(got) == len(rows)
        for i, text, lang in rows:
            for name, by in (("log_ppl", plain.get(lang or "und", pooled)), ("pooled", pooled)):
                want = by.log_ppl(text)
                assert got[i][name] == (want if want is None else pytest.approx(want, rel=1e-9)), (text, lang, name, sent)
    nothing = ngram_perplexity.fit(docs.limit(0))
    for sent in (ngram_perplexity.SENT, -1):
        assert all(r["log_ppl"] is None and r["pooled"] is None for r in ngram_perplexity.measure(docs, nothing, sent).collect())


def test_all_models_take_the_same_few_shuffles(spark):
    docs = spark.createDataFrame([(i, f"the sea was calm and {w} night came", "ab"[i % 2]) for i, w in enumerate(("then", "no", "one"))], "doc_id long, text string, lang string")
    shuffles = spark.sparkContext._jsc.sc().newShuffleId
    before = shuffles()
    assert ngram_perplexity.rule(docs).count() == 3
    assert shuffles() - before <= 40


def test_large_models_come_in_pieces(spark):
    """Beyond what is sent at once no n-gram of a text is shuffled; pieces give what the whole model gives, also for texts that were not counted."""
    docs = table(spark, SMALL, "documents").where("doc_id < 60").select("doc_id", "text", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    model = ngram_perplexity.fit(docs.where("doc_id % 2 = 0"))
    want = sorted(map(tuple, ngram_perplexity.measure(docs, model).collect()))
    shuffles = spark.sparkContext._jsc.sc().newShuffleId
    before = shuffles()
    got = ngram_perplexity.measure(docs, model, 0).collect()
    assert shuffles() - before <= 4  # those that count the model's entries
    assert sorted(map(tuple, got)) == want
    model.drop()
    model = ngram_perplexity.fit(docs)
    own = {r["doc_id"]: r for r in ngram_perplexity.measure(docs, model).collect()}
    model.shared.clear()
    split = model._replace(highest=model.highest.repartition(5))
    got = ngram_perplexity.measure(docs, split, 0, counted=True).collect()
    assert len(split.shared) == 5 and len(got) == len(own) and all(r == own[r["doc_id"]] for r in got)
    with pytest.raises(Exception, match="texts changed"):
        ngram_perplexity.measure(docs.withColumn("text", F.concat("text", F.lit(" 漢字"))), split, 0, counted=True).collect()
    model.drop()


def test_texts_in_hand_are_bounded():
    rng = np.random.default_rng(6)
    texts = [None, "", *("".join(rng.choice(list("abcdefgh  "), 12_000)) for _ in range(400))]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts, "lang": ["ab"[i % 2] for i in range(len(texts))]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())]))
    every = np.unique(ngram_perplexity.Read.of(batch).key)
    for bytes_most, keys_most in ((1_500_000, 4_000_000), (1 << 40, 100_000), (1 << 40, 1 << 40)):
        groups = list(ngram_perplexity.in_hand(iter([batch.slice(0, 250), batch.slice(250)]), bytes_most, keys_most))
        assert [i for held, _ in groups for b in held for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
        assert all(sum(b.column("text").nbytes for b in held) <= bytes_most + 600_000 and (np.diff(need) > 0).all() for held, need in groups)
        assert np.array_equal(np.unique(np.concatenate([need for _, need in groups])), every)
        assert (len(groups) == 1) == (keys_most == 1 << 40)


def test_bands_reject_what_is_unlike_the_language(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["the", "sea", "was", "calm", "and", "then", "night", "came"], 60)), "en") for i in range(120)]
    rows.append((999, " ".join("".join(map(chr, rng.integers(33, 126, 9))) for _ in range(60)), "en"))
    got = {r["doc_id"]: r["kept"] for r in ngram_perplexity.rule(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[999] and sum(got.values()) >= 118


def test_each_side_has_its_own_limit(spark):
    x = np.concatenate([-np.arange(1, 101) / 1000, [0.0], np.arange(1, 101) / 100])
    rows = [("en", float(v), False) for v in x] + [("en", 50.0, True), ("en", None, False)]
    r = ngram_perplexity.bands(spark.createDataFrame(rows, "lang string, log_ppl double, base_failed boolean"), "log_ppl").first()
    assert r["mid"] == 0 and r["below"] == pytest.approx(1.4826 * 0.05) and r["above"] == pytest.approx(1.4826 * 0.5) and r["total"] == 201


def test_every_script_is_read(spark):
    """Texts whose letters, not their places, tell them apart: a model that folds scripts sees the same in all."""
    rng = np.random.default_rng(5)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    rows = [(i, text("абвгдежз"), "ru") for i in range(150)] + [(900, text("漢字假名交文章語"), "ru"), (901, text("опрстуфх"), "ru")]
    rows.append((902, ("слово " * 3 + "ж" * 40 + " ") * 30000, "ru"))  # a very long one
    got = {r["doc_id"]: r["kept"] for r in ngram_perplexity.rule(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[900] and not got[901] and not got[902] and sum(got[i] for i in range(150)) >= 147


def test_junk_of_the_labels_is_rejected(spark):
    path = "/root/testdata/sf0.01"
    got = ngram_perplexity.op1_ngram_perplexity(spark, path).where("not base_failed").join(table(spark, path, "labels"), "doc_id")
    share = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[0] < 0.5 and share[1] > 0.95


def test_documents_of_small_languages(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    text = lambda: " ".join(rng.choice(words, 60))
    rows = [(i, text(), "en") for i in range(300)] + [(1000 + i, text(), f"rare{i}") for i in range(6)] + [(1006, text(), None), (1007, text(), "*")]
    rows += [(2000, " ".join("".join(map(chr, rng.integers(33, 126, 9))) for _ in range(60)), "junk")]
    got = {r["doc_id"]: r["kept"] for r in ngram_perplexity.rule(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[1000 + i] for i in range(8)) and not got[2000]


def test_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.op3_language_bitmask(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.select("doc_id", "held_out").collect())
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() and got.count() == docs.count()
    odd = spark.createDataFrame([(i, t, i) for i, t in enumerate(EDGE)], "doc_id long, text string, score int")
    model = language_id.fit(docs)
    for r in language_id.predict(odd, model).collect():
        text = r["row"]["text"]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
    assert language_id.predict(odd.limit(0), model).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_filter_names_all_languages_of_an_ngram():
    f = language_id.Filter([f"l{i}" for i in range(70)], np.array([0, 1, 69, 1]), np.array([5, 5, 5, 7]))
    at = language_id.slots(np.array([5, 7, 9]))
    has = lambda i: [bool(x) for x in f._bit(f.masks[i // 64][at[0]] & f.masks[i // 64][at[1]] & f.masks[i // 64][at[2]], i)]
    assert has(0) == [True, False, False] and has(1) == [True, True, False] and has(69) == [True, False, False] and has(5) == [False] * 3


def test_quality(spark):
    path = "/root/testdata/sf0.01"
    got = quality_classifier.op7_subword_quality(spark, path)
    held = got.join(table(spark, path, "labels"), "doc_id").where("held_out")
    right = held.where("predicted = quality").count()
    assert right >= 0.95 * held.count() and got.count() == table(spark, path, "documents").count()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(EDGE)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 3 if i % 3 < 2 else None) for i in range(len(EDGE))], "doc_id long, quality int")
    for known in (labels, labels.where("quality = 1"), labels.limit(0)):
        rows = quality_classifier.score(docs, quality_classifier.fit(docs, known)).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] > 0.9 for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels.where("quality = 1"))).collect())


def test_features_against_brute_force():
    import pyarrow as pa

    from candlewick.llm.textvec import Texts

    texts = ["ab abc ab ab", None, "", "x", "né né"]
    bags = list(quality_classifier.bags(Texts(pa.array(texts))))

    def n_features(t):
        raw = re.sub(rb"[\x20\x09-\x0d]", b" ", (t or "").encode())
        words = raw.split()
        grams = sum(1 for n in (3, 5) for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1])
        return len(words) + max(0, len(words) - 1) + sum(a == b for a, b in zip(words, words[1:], strict=False)) + grams

    for (at, share), t in zip(bags, texts, strict=True):
        assert n_features(t) == 0 and len(at) == 0 or share.sum() == pytest.approx(1) and min(share) == pytest.approx(1 / n_features(t))


def test_language_against_brute_force(spark):
    """Exact profiles in dictionaries instead of the filter; the filter is nearly empty, so it hardly adds any n-gram by chance."""
    docs = [(r["text"], r["lang"]) for r in table(spark, SMALL, "documents").select("text", "lang").limit(150).collect()] + [(None, "en"), ("a", None), ("Ünïcode ß", "xx"), ("Ünïcode ß", "xx")]
    import pyarrow as pa

    from candlewick.llm.textvec import Texts

    def grams(text):
        gram, _ = language_id.grams(Texts(pa.array([text], pa.string())))
        return gram.tolist()

    def naive(text):
        code = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in (text or "").encode()]
        line = [0, 0, *code, 0, 0]
        n = len(line)
        kept = [c for i, c in enumerate(line) if i < 2 or i >= n - 2 or c or line[i - 1]]
        out = [kept[i : i + 4] for i in range(len(kept) - 3)]
        return [int.from_bytes(bytes(g), "big") for g in out if g[1] or g[2]]

    for text in [*EDGE, *(t for t, _ in docs[:20])]:
        assert grams(text) == naive(text)
    profile, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        if text is not None and lang is not None:
            profile[lang].update(naive(text))
            total[lang] += len(naive(text))
    least = 1e-3
    kept = {k: {g for g, n in c.items() if n >= total[k] * least} for k, c in profile.items()}
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(docs)], "doc_id long, text string, lang string").repartition(3)
    long_ = " ".join(t or "" for t, k in docs if k == "de") * 40
    asked = df.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(EDGE, 1000)] + [(2000, long_), (5, docs[5][0])], "doc_id long, text string"))
    got = language_id.predict(asked, language_id.fit(df, min_share=least)).collect()
    assert len(got) == asked.count()
    for r in got:
        text = r["row"]["text"]
        own = naive(text)
        share = {k: sum(g in v for g in own) / max(1, len(own)) for k, v in kept.items()}
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        best = max(share.values())
        assert share[r["lang_pred"]] >= best - 1e-3 and r["score"] == pytest.approx(best, abs=2e-3)


def test_quality_against_brute_force(spark):
    """The same features, steps and scores with dictionaries and loops over words."""
    mask = (1 << 64) - 1

    def mix(x):
        x &= mask
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def named(word):
        total, power = len(word), 1
        for b in word:
            total, power = (total + mix(b + 1) * power) & mask, power * 0x9E3779B97F4A7C15 & mask
        return mix(total)

    def buckets(text):
        raw = re.sub(rb"[\x20\x09-\x0d]", b" ", (text or "").encode())
        words = [named(w) for w in raw.split()]
        found = words + [mix(a * 3 + b) for a, b in zip(words, words[1:], strict=False)] + [1 for a, b in zip(words, words[1:], strict=False) if a == b]
        found += [mix(int.from_bytes(raw[i : i + n], "big") * n) for n in (3, 5) for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1]]
        return Counter(mix(x) % quality_classifier.BUCKETS for x in found)

    texts = [*EDGE, "good text here", "bad bad bad", "more good text", "bad text"]
    label = [i % 2 for i in range(len(texts))]
    bags = [{b: n / sum(c.values()) for b, n in sorted(c.items())} for c in map(buckets, texts)]
    dim, epochs, rate = quality_classifier.DIM, 2, quality_classifier.RATE
    rng = np.random.default_rng(quality_classifier.SEED)
    table_ = rng.uniform(-1 / dim, 1 / dim, (quality_classifier.BUCKETS, dim))
    vectors = {b: [float(x) for x in table_[b]] for bag in bags for b in bag}
    out, bias, done = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            step = rate * (1 - done / (epochs * len(bags)))
            done += 1
            mean = [sum(share * vectors[b][j] for b, share in bags[i].items()) for j in range(dim)]
            z = [sum(mean[j] * out[j][k] for j in range(dim)) + bias[k] for k in (0, 1)]
            p = np.exp(np.array(z) - max(z))
            p = [float(x) for x in p / p.sum()]
            p[label[i]] -= 1
            pull = [out[j][0] * p[0] + out[j][1] * p[1] for j in range(dim)]
            for j in range(dim):
                for k in (0, 1):
                    out[j][k] -= step * 0.1 * mean[j] * p[k]
            bias = [bias[k] - step * 0.01 * p[k] for k in (0, 1)]
            for b, share in bags[i].items():
                vectors[b] = [v - step * share * pull[j] * min(50, len(bags[i])) for j, v in enumerate(vectors[b])]
    rows = [(np.array(list(b), np.int64), np.array(list(b.values()))) for b in bags]
    model = quality_classifier.sgd(rows, np.array(label), epochs=epochs)
    fold = {b: sum(v[j] * (out[j][1] - out[j][0]) for j in range(dim)) for b, v in vectors.items()}
    assert all(model[b] == pytest.approx(x, abs=1e-9) for b, x in fold.items()) and model[-1] == pytest.approx(bias[1] - bias[0], abs=1e-9)
    very_long = "good text here " * 100_000
    asked = [*texts, texts[-1], very_long]
    got = {r["row"]["doc_id"]: r["score"] for r in quality_classifier.score(spark.createDataFrame([(i, t, "x") for i, t in enumerate(asked)], "doc_id long, text string, score string"), model).collect()}
    assert len(got) == len(asked)
    for i, text in enumerate(asked[:-1]):
        bag = buckets(text)
        z = sum(n * model[b] for b, n in bag.items()) / max(1, sum(bag.values())) + model[-1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    assert got[len(texts)] == got[len(texts) - 1] and 0 <= got[len(asked) - 1] <= 1
