import base64
import hashlib
import random
import warnings
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import best_fit_packing, chunk_bpe, knn_join, quote_linking, token_rollups, warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 77\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def archived(spark, rows, path, least=0):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write(pages.repartition(2), path, least)
    return sorted((tuple(r) for r in warc.resolved(warc.read(spark, path)).collect()), key=str)


def expected(rows, least=0):
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        size = len((t or "").encode())
        again = i is not None and size >= least and i > first[t or ""]
        out.append((i, size, sha(t), "revisit" if again else "response", first[t or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "1500", "900"])
def test_warc_round_trip(spark, tmp_path, split):
    r = random.Random(5)
    rows = [(1, "http://a/\r\nb", "é\nü"), (2, None, None), (3, "u", ""), (4, "u", "é\nü"), (None, "u", "é\nü"), (5, "u", FAKE * 3), (6, "u", "x\n" + FAKE[:40]), (7, "u", "WARC/1.1\r\n" * 20), (8, "u", FAKE), (1, "u", "é\nü"), (9, "u", "\r\n\r\n" + FAKE + "\n")]
    rows += [(10 + i, "u", "\n".join("p" * r.randint(0, 300) for _ in range(r.randint(0, 30)))) for i in range(40)] + [(60, "u", "z" * 9000), (61, "u", "z" * 9000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert archived(spark, rows, str(tmp_path / "w")) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_threshold_empty_and_broken(spark, tmp_path):
    rows = [(2, "u", "short"), (1, "u", "short"), (4, "u", "a longer one"), (3, "u", "a longer one")]
    assert archived(spark, rows, str(tmp_path / "a"), 8) == expected(rows, 8)
    assert archived(spark, [], str(tmp_path / "b")) == []
    twice = [(1, "u", "A"), (1, "u", "BBBB"), (2, "u", "BBBB"), (3, "u", "A")]  # an id that names two payloads
    assert archived(spark, twice, str(tmp_path / "d")) == expected(twice)
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.warc").write_text(good + "junk\n" + good.replace("ID: 1", "ID: 2"), newline="")
    assert [r["page_id"] for r in warc.read(spark, str(tmp_path / "c")).collect()] == [1]


@pytest.mark.parametrize("split", ["128m", "5000"])
def test_warc_long_headers(spark, tmp_path, split):
    long = (1, "data:text/html," + "é:" * 50_000, "long")
    short = [(2, "u", "two"), (3, "u", FAKE)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for at in range(3):
            rows = short[:at] + [long] + short[at:]
            path = str(tmp_path / str(at))
            warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
            assert sorted((tuple(r) for r in warc.resolved(warc.read(spark, path)).collect()), key=str) == expected(rows)
        # many lines over several ranges; the length is named first, last, in the middle, or twice, of which the last counts
        filler = [f"X-{i}: {'y' * 90}" for i in range(200)]
        wanted, text = [], ""
        for i, at in enumerate([(0,), (200,), (100,), (0, 150), (200, 0)]):
            lines = filler[:]
            for k, a in enumerate(sorted(at, reverse=True)):
                lines.insert(a, f"Content-Length: {10 if k == 0 else 999}")
            text += "\r\n".join(["WARC/1.1", "WARC-Type: response", f"WARC-Page-ID: {i}", *lines, "", "0123456789", "", ""])
            wanted.append((i, 10))
        fake = "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n" + "A: b\r\n" * 3000
        text += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 9\r\nContent-Length: {len(fake)}\r\n\r\n{fake}\r\n\r\n"
        wanted.append((9, len(fake)))
        (tmp_path / "many").mkdir()
        (tmp_path / "many" / "one.warc").write_text(text, newline="")
        assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read(spark, str(tmp_path / "many")).collect()) == wanted
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_turns_and_broken_chains(spark, tmp_path, monkeypatch):
    rows = [(i, "data:text/html," + "x" * 70_000 if i == 90 else f"u{i}", f"{i} " + "p" * 1000) for i in range(600)]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    monkeypatch.setattr(warc, "RANGES", 2)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error", UserWarning)
            assert sorted((tuple(r) for r in warc.resolved(warc.read(spark, path)).collect()), key=str) == expected(rows)
        cut = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
        (tmp_path / "b").mkdir()
        (tmp_path / "b" / "good.warc").write_text(cut * 3, newline="")
        (tmp_path / "b" / "bad.warc").write_text(cut + "lost\n" + cut, newline="")
        (tmp_path / "b" / "none.warc").write_text("nothing here\n", newline="")
        with pytest.warns(UserWarning, match="2 archive files have a broken chain"):
            assert warc.read(spark, str(tmp_path / "b")).count() == 4
        told = warc.broken(warc.chains(spark, str(tmp_path / "b"))).collect()
        assert sorted((r["size"], r["reached"]) for r in told) == [(13, 0), (2 * len(cut) + 5, len(cut))]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def naive_pack(sizes, lengths):
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = Counter(sizes)
    bins, where = [], {}

    def fill(length, first):
        room, got = length - first, Counter([first])
        for s in sorted(left, reverse=True):
            while s <= room and left[s] > got[s]:
                room -= s
                got[s] += 1
        return length - room

    for now, i in enumerate(order):
        s = sizes[i]
        open_ = [(b[0] - b[1], n) for n, b in enumerate(bins) if b[0] - b[1] >= s]
        if open_:
            n = max((n for room, n in open_ if room == min(open_)[0]), key=lambda n: bins[n][2])  # ties: the bin changed last
        else:
            n = len(bins)
            bins.append([min((x for x in lengths if x >= s), key=lambda x: (best_fit_packing.cost(x) / fill(x, s), -x)), 0, 0])
        left[s] -= 1
        bins[n][1] += s
        bins[n][2] = now
        where[i] = n
    return [min(x for x in lengths if x >= b[1]) for b in bins], Counter(bins[where[i]][1] for i in where)


def test_packing_against_plain_best_fit():
    rng = np.random.default_rng(6)
    for lengths in ((64,), (16, 32, 64), (10, 64)):
        sizes = rng.integers(1, 65, 300)
        where, offset, final = best_fit_packing.pack(sizes, lengths)
        want, used = naive_pack(sizes.tolist(), lengths)
        got = np.bincount(where, weights=sizes).astype(int)
        assert sorted(final.tolist()) == sorted(want) and Counter(got[where].tolist()) == used
        for b in range(len(final)):
            own = sorted(zip(offset[where == b], sizes[where == b], strict=True))
            assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))] and got[b] <= final[b]


def test_packed_documents(spark):
    rows = [(1, "a b c", 9), (None, "d", 9), (2, None, 9), (3, " ", 9), (4, "w " * 10000, 9), (1, "a b c", 9)]
    out = best_fit_packing.packed(spark.createDataFrame(rows, "doc_id long, text string, n int").coalesce(1)).toPandas()
    assert out[out.bin_id.isna()].n_tokens.tolist() == [0, 0] and out.n_tokens.sum() == 3 + 1 + 10000 + 3
    big = out[out.n_tokens > 100].sort_values("piece")
    assert big.start.tolist() == [0, 4096, 8192] and big.n_tokens.tolist() == [4096, 4096, 1808]
    full = out.dropna(subset=["bin_id"])
    assert (full.groupby("bin_id").n_tokens.sum() == full.groupby("bin_id").bin_used.first()).all() and (full.bin_used <= full.bin_length).all()
    assert best_fit_packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    many = spark.range(2500).selectExpr("id as doc_id", "repeat('w ', int(id % 50)) as text").coalesce(1)
    windows = best_fit_packing.packed(many, window=700).toPandas()
    assert len(windows) == 2500 and (windows.groupby("bin_id").n_tokens.sum() <= windows.groupby("bin_id").bin_length.first()).all()


@pytest.mark.parametrize(("n", "scale", "block"), [(300, 1.0, 64), (120, 1e5, 8192), (8, 1.0, 3)])
def test_knn_against_brute_force(spark, n, scale, block):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 6)) * scale * rng.choice([0.1, 1, 3], (n, 1))
    v[::7] = v[0]
    rows = [(int(i), [float(x) for x in v[i]], "x") for i in range(n)] + [(1000, None, "x"), (1001, [1.0, None] + [0.0] * 4, "x"), (1002, [float("nan")] * 6, "x"), (1003, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (1004, [], "x")]
    got = knn_join.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"), F.col("id") % 5 == 0, k=10, pivots=7, block=block).collect()
    ints = np.floor(v * 1024).astype(np.int64).astype(object)
    want = []
    for q in range(0, n, 5):
        top = sorted((-int(ints[q] @ ints[i]), i) for i in range(n) if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(top, 1)]
    assert sorted(tuple(r) for r in got) == want


def test_knn_repeated_ids_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=4 if i % 3 else 7)]) for i in range(120)]
    rows += rows[:40] + [(i, [float(x) for x in rng.normal(size=4)]) for i in (0, 5, 5, 6, 200)] + [(7, [1.0])]
    got = knn_join.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("id") % 5 == 0, k=4, pivots=5, block=16).collect()
    one = sorted({(i, tuple(int(np.floor(x * 1024)) for x in v)) for i, v in rows})
    want = []
    for q, v in one:
        if q % 5 == 0:
            top = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in one if i != q and len(w) == len(v))[:4]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(top, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_knn_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn_join.knn_join(none, F.col("id") % 5 == 0).count() == 0
    assert knn_join.knn_join(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>"), F.col("id") % 5 == 0).count() == 0


def test_bpe_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh'éß漢😀.,!1", k=r.randint(1, 12)))
    passage = " ".join(word() for _ in range(3000))
    solid = "x'reé" * 4000
    texts = [None, "", " \n", "a<|endoftext|>b", passage, passage + " tail", "head " + passage, "glued" + passage + "glued", passage[:9000] + passage[5000:20000], solid, solid + "y", "é " * 3, "a\x1cb\x0bc\x85d\xa0e", "İΣς", passage]
    texts += ["".join(r.choices([passage[r.randrange(9000) :][: r.randint(1, 6000)], word(), " ", "\n"], k=4)) for _ in range(12)]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    file = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError, match="end-of-word"):
        chunk_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(file)
    want = []
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(i if i else None), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(x["id"]), *tuple(x)[1:]) for x in chunk_bpe.encoded(docs, file).collect()]
    assert sorted(got) == sorted(want)
    assert chunk_bpe.encoded(docs.limit(0), file).count() == 0


MESSAGES = [
    (1, 0, "user", "Shall we meet?\n\nBring the red book."),
    (1, 1, "assistant", "Yes, at noon."),
    (1, 2, "user", "> Yes, at noon.\n>> Shall we meet?\nToo early"),
    (1, 3, "assistant", ">bring  THE red book.\n\nI will"),
    (1, 4, "user", "> > Yes, at noon.\n> Too early\nThen at one"),
    (1, 5, "user", "> nobody said this\nhm"),
    (1, 6, "user", "> Yes, at noon.\n> extra line nobody said\nok"),
    (2, 0, "user", "Yes, at noon."),
    (2, 1, "user", None),
    (None, 1, "user", "> Yes, at noon."),
    (2, None, "user", "> Yes, at noon."),
    (2, 2, "user", ""),
    (3, 5, "user", "again and again"),
    (3, 5, "user", "again and again"),
    (3, 2500, "user", "> again and again"),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*m, "x") for m in MESSAGES], "conv_id long, turn long, role string, text string, level string").repartition(3)
    out = quote_linking.conversations(df)
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert out.count() == len(MESSAGES)
    link = {k: r["reply_to"] for k, r in got.items() if r["reply_to"] is not None}
    assert link == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 2, (1, 6): 1, (3, 2500): 5}
    assert (got[1, 4]["thread"], got[1, 4]["depth"]) == (0, 3) and (got[1, 0]["thread"], got[1, 0]["depth"]) == (0, 0)
    assert got[1, 2]["text"] == "Too early" and got[1, 2]["max_level"] == 2 and got[1, 2]["n_quotes"] == 2 and got[2, 1]["text"] == ""
    plain = sorted(tuple(r[c] for c in sorted(out.columns)) for r in out.where("conv_id is not null and turn is not null").collect())
    con = duckdb.connect()
    con.register("conversations", df.where("conv_id is not null and turn is not null").toPandas())
    sql = con.execute(quote_linking.ORACLE)
    names = [c[0] for c in sql.description]
    assert plain == sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in sql.fetchall())
    assert quote_linking.conversations(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_short_quotes(spark):
    rows = [(1, 0, "Shall we?"), (1, 1, "Yes"), (1, 2, "No"), (1, 3, "> Yes\nGood"), (1, 4, ">No\n\nPity"), (1, 5, "> はい\nnobody said so"), (1, 6, "> Good\n> ok\nfine"), (1, 7, ">\n> \nempty")]
    rows += [(3, 0, "Ja\nwell\nNo"), (3, 1, "> Ja\n> No\nhm"), (3, 2, "> hm\n> y")]
    rows += [(2, 0, "好"), (2, 1, "> 好\n行"), (2, 2, "> 行\n吗"), (2, 3, "so\nbe it"), (2, 4, "> so\na line quoted alone"), (2, 5, "> so\n> never said\nno")]
    out = quote_linking.conversations(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"]) for r in out.collect() if r["reply_to"] is not None}
    assert got == {(1, 3): (1, 1, 1), (1, 4): (2, 2, 1), (1, 6): (3, 1, 2), (2, 1): (0, 0, 1), (2, 2): (1, 0, 2), (2, 4): (3, 3, 1), (2, 5): (3, 3, 1), (3, 1): (0, 0, 1), (3, 2): (1, 0, 2)}


def test_generated_quotes_against_sql(spark):
    """Conversations of messages that quote earlier ones at several levels, short and long, in part and whole."""
    r = random.Random(11)
    rows = []
    for conv in range(60):
        own, shown = [], []
        for turn in range(r.randint(1, 14)):
            said = "\n".join(" ".join(r.choices(["yes", "no", "ok", "Why", "好", "the", "Plan", "works", "later", "a"], k=r.randint(1, 4))) for _ in range(r.randint(1, 3)))
            text = said
            for _ in range(r.choice([0, 1, 1, 2])):
                if not shown:
                    break
                lines = (r.choice(shown) if r.random() < 0.6 else r.choice(own)).split("\n")
                if r.random() < 0.3:
                    lines = lines[: r.randint(1, len(lines))]
                text = "\n".join("> " + x for x in lines) + "\n" + text if r.random() < 0.8 else text + "\n" + "\n".join(">" + x for x in lines)
            own.append(said)
            shown.append(text)
            rows.append((conv, turn, r.choice(["user", "assistant"]), text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = quote_linking.conversations(df)
    got = sorted(tuple(x[c] for c in sorted(out.columns)) for x in out.collect())
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    sql = con.execute(quote_linking.ORACLE)
    names = [c[0] for c in sql.description]
    assert key_none(got) == key_none(tuple(row[names.index(c)] for c in sorted(names)) for row in sql.fetchall())
    linked = [x for x in got if x[sorted(out.columns).index("reply_to")] is not None]
    assert len(linked) > 100


def key_none(rows):
    return sorted(rows, key=str)


def test_inner_levels_and_order(spark):
    rows = [(0, "where to?"), (1, "north"), (2, "south then"), (3, "> south then\n>> where to?\nfine"), (4, "> north\n> > where to?\ncold"), (5, "> fine\ngood"), (6, "> where to?\nhome")]
    out = quote_linking.conversations(spark.createDataFrame([(1, t, "user", x) for t, x in rows], "conv_id long, turn long, role string, text string"))
    got = {r["turn"]: (r["reply_to"], r["thread"], r["depth"], r["position"]) for r in out.collect()}
    assert got == {0: (None, 0, 0, 0), 1: (0, 0, 1, 1), 4: (1, 0, 2, 2), 2: (0, 0, 1, 3), 3: (2, 0, 2, 4), 5: (3, 0, 3, 5), 6: (0, 0, 1, 6)}


def test_rollups(spark, tmp_path):
    kind = "source string, lang string, tokenizer_version string, tokens long"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    store = token_rollups.Rollup(spark, str(tmp_path / "r")).create()
    totals = lambda: sorted((tuple(r) for r in store.totals().collect()), key=str)
    assert totals() == []
    assert store.commit("a", token_rollups.insert(rows(("s", "en", "1", 10), ("s", "en", "1", 5), (None, None, "1", None), ("t", "de", "1", 7))))
    assert store.commit("b", token_rollups.delete(rows(("t", "de", "1", 7)))) and not store.commit("b", token_rollups.delete(rows(("t", "de", "1", 7))))
    store.commit("c", token_rollups.revise(rows(("s", "en", "1", 5)), rows(("s", "en", "2", 9))))
    want = sorted([("s", "en", "1", 1, 10), ("s", "en", "2", 1, 9), (None, None, "1", 1, 0)], key=str)
    assert totals() == want
    spark.createDataFrame([("s", "en", "1", 1, 999)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long").write.parquet(str(tmp_path / "r/data/torn"))
    assert totals() == want  # a batch without a log entry is not read
    store.compact()
    assert totals() == want and not store.commit("a", token_rollups.insert(rows(("s", "en", "1", 10))))
    assert store.commit("d", token_rollups.insert(rows())) and totals() == want
    # a compaction that stops before its entries are written leaves the log as it was
    spark.createDataFrame([("s", "en", "1", 7, 7)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long").write.parquet(str(tmp_path / "r/data/stopped"))
    assert totals() == want
    store.compact()
    store.compact()
    assert totals() == want and len(store.pieces()) == 1 and not store.commit("c", token_rollups.insert(rows(("s", "en", "1", 10))))
    store.log.EVERY = 4
    for i in range(24):
        assert store.commit(f"n{i}", token_rollups.insert(rows(("n", "en", "1", i))))
        if i % 8 == 7:
            store.compact()
    again = token_rollups.Rollup(spark, str(tmp_path / "r"))
    assert len(again.log.names()) <= 12 and len(again.pieces()) == 1 and not again.commit("n3", token_rollups.insert(rows(("n", "en", "1", 1))))
    assert totals() == sorted([*want, ("n", "en", "1", 24, sum(range(24)))], key=str)


def test_rollups_of_repeated_rows_and_long_texts(spark, tmp_path):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, "a b", "s", "en"), (None, "a b", "t", None), (3, None, "s", "en"), (4, "", "s", "en"), (5, "it's " * 60000, "s", "de"), (6, "it's " * 60000, "t", "de")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, tokens string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in token_rollups.op10_token_rollups(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("s", "en", "words-1", 3, 4), ("t", None, "words-1", 1, 2), ("s", "de", "pieces-2", 1, 180000)], key=str)


def test_contents_of_counts(spark):
    texts = [None, "", "ab cd", "it's 12"]
    got = token_rollups.counted(spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")).orderBy("doc_id").collect()
    assert [(r["words"], r["pieces"]) for r in got] == [(0, 0), (0, 0), (2, 2), (2, 5)]
    assert got[0]["digest"] == got[1]["digest"] and isinstance(defaultdict(int), dict)
