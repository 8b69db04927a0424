"""Manifest, language model and spelling variants against plain Python; columns named like the operators' own."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import common, line_crf, merkle, mixing, ngram_join, packing, pitman_yor, sharding, spelling, toxicity
from lithoframe.llm import queries as registered

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _group string, _hash int, _run string, word int, body string"


@pytest.fixture(scope="module")
def odd(spark):
    prose = " ".join(f"word{chr(97 + k % 26)}xyz" for k in range(300))
    texts = [None, "", " \n\t", "one", "Letters LETTERS lettersx letterz etters lettters", prose, prose, "é" * 50, "ÀÉcafé naïveté NAÏVETÉ", "a\nb\n"]
    made = [(i, t, "en", f"s{i % 2}" if i % 3 else None, i, "x", 1, "y", 2, "z") for i, t in enumerate(texts)]
    made += [made[5], made[5], (None, prose, None, None, None, None, None, None, None, None), (None,) * 10, (99, None, None, "é", None) + (None,) * 5]
    return spark.createDataFrame(made, SCHEMA).cache()


def crc(text):
    return zlib.crc32(text.encode())


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def brute_manifest(rows, arity, broken):
    """(leaf, subroot, root, proof, folded) of every row, by plain recursion over lists."""
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k:k + arity])) for k in range(0, len(levels[-1]), arity)])
        return levels

    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id is not None, r.doc_id, leaf(r, r.text), leaf(r, broken(r)), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:1] + (x[1] or 0, x[2]))]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for k, (_, _, own, other, r) in enumerate(sorted(by[s], key=lambda x: x[:1] + (x[1] or 0, x[2]))):
            h, siblings = other, []
            for levels, at in ((trees[s], k), (top, g)):
                for level in levels[:-1]:
                    run = level[at // arity * arity:at // arity * arity + arity]
                    siblings += run[:at % arity] + run[at % arity + 1:]
                    h = sha("".join(run[:at % arity] + [h] + run[at % arity + 1:]))
                    at //= arity
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], sha("".join(siblings)), h, h == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest(spark, odd, arity):
    broken = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet"), odd.limit(1), odd.limit(0)):
        got = merkle.manifest(df, fields, "source", "doc_id", {"text": broken}, merkle.Settings(arity))
        got = Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
        assert got == brute_manifest(df.collect(), arity, lambda r: r.text.replace("\n", "") if r.text and (r.doc_id or 0) % 2 else r.text)


def brute_variants(texts, damage):
    n = Counter()
    for i, t in texts:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = damage(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in w))
            n[w] += len(w) >= 7
    n = {w: k for w, k in n.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    partners = {w: [v for k in (-1, 0, 1) for v in by[len(w) + k] if near(w, v)] for w in n}
    form = {w: min(p, key=lambda v: (-n[v], v)) for w, p in partners.items() if p}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n[w], len(partners[w]), n.get(form.get(w))) for w in n)


def test_variants(spark, odd):
    rng = np.random.default_rng(4)
    base = ["aabbccdd", "letters", "ettersl", "straßen", "élèvesse", "aaaaaaaa"]
    words = [w for w in base for _ in range(400)]
    for _ in range(3000):   # one or two edits, so that chains and shared letters come up
        w = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(1, 3)):
            k, c = rng.integers(len(w)), "abcdelrsté"[rng.integers(10)]
            w[k:k + rng.integers(0, 2)] = [c] * rng.integers(0, 2)
        words += ["".join(w)] * int(rng.geometric(0.3))
    made = spark.createDataFrame([(k, " ".join(words[k::50])) for k in range(50)], "doc_id long, text string")
    for df in (made, odd, odd.limit(0)):
        want = brute_variants([(r.doc_id, r.text) for r in df.collect()], lambda i, w: w)
        for parts in (3, 7):
            got = sorted(tuple(r) for r in spelling.variants(df, settings=spelling.Settings(parts=parts)).collect())
            assert got == want
    assert any(r[1] and r[2] != r[1] for r in brute_variants([(r.doc_id, r.text) for r in made.collect()], lambda i, w: w))


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_seating_is_that_of_the_restaurant():
    """Tables of a dish of three customers, beside all seatings weighed one by one."""
    d, theta, p0, others, n = 0.6, 1.0, 0.3, 5, 60_000
    a = (theta + d * (others + 1)) * p0
    weights = np.array([(1 - d) * (2 - d), 3 * a * (1 - d), a * a])
    got = pitman_yor.seat(np.full(n, 3), np.full(n, p0), np.zeros(n, np.int64), np.array([others + 1]), np.zeros(1, bool), d,
                          pitman_yor.Settings(sweeps=6), np.random.default_rng(1))
    assert np.allclose(np.bincount(got, minlength=4)[1:] / n, weights / weights.sum(), atol=0.01)
    live = np.array([2], np.int64)     # the count of tables follows the moves
    seats = pitman_yor.seat(np.array([40, 7]), np.array([0.3, 0.2]), np.zeros(2, np.int64), live, np.ones(1, bool), d,
                            pitman_yor.Settings(), np.random.default_rng(2))
    assert live[0] == seats.sum() and (1 <= seats).all() and seats[0] <= 40


def test_every_customer_is_seated_anew():
    """One sweep of a large dish comes near the tables of many sweeps, a few dishes alone too, and moves as many customers as there are."""
    d, c, p0, n = 0.6, 300, 0.02, 400
    run = lambda sweeps, k: pitman_yor.seat(np.full(k, c), np.full(k, p0), np.zeros(k, np.int64), np.array([50]), np.zeros(1, bool), d,
                                            pitman_yor.Settings(sweeps=sweeps), np.random.default_rng(3))
    many = run(12, n).mean()
    assert abs(run(1, n).mean() - many) < 0.1 * many and abs(run(12, 8).mean() - many) < 0.5 * many
    draws = []

    class Counted(np.random.Generator):
        def random(self, size=None):
            draws.append(size)
            return super().random(size)

    pitman_yor.seat(np.array([100]), np.array([p0]), np.zeros(1, np.int64), np.array([50]), np.zeros(1, bool), d,
                    pitman_yor.Settings(), Counted(np.random.PCG64(1)))
    assert (100, 2) in draws    # a draw of where each customer leaves, and one of where it sits


def test_tables_are_drawn_from_their_distribution():
    """Numbers of tables of many dishes, of sizes side by side, beside those that all seatings of c customers weigh; large ones take no move each."""
    d, theta, p0, others = 0.6, 1.0, 0.02, 50
    a = (theta + d * others) * p0
    sizes = np.repeat([4, 30, 300], 4000)
    got = pitman_yor.seat(sizes, np.full(len(sizes), p0), np.zeros(len(sizes), np.int64), np.array([others]), np.zeros(1, bool), d,
                          pitman_yor.Settings(), np.random.default_rng(5))
    for c in (4, 30, 300):
        t, weight = np.arange(1, c + 1), np.eye(1, c)[0]
        for n in range(1, c):
            weight = np.r_[0, weight[:-1]] * a + np.maximum(n - d * t, 0) * weight
            weight /= weight.sum()
        assert abs(got[sizes == c].mean() - (weight * t).sum()) < 0.08
    calls = []

    class Counted(np.random.Generator):
        def random(self, size=None):
            calls.append(size)
            return super().random(size)

    pitman_yor.seat(np.full(64, 5000), np.full(64, 1e-4), np.arange(64), np.full(64, 9), np.ones(64, bool), d,
                    pitman_yor.Settings(), Counted(np.random.PCG64(1)))
    assert len(calls) < 1000


def test_model_without_chance(spark):
    """Where every pair comes once, all is determined but the parent, whose words come once too: score by hand."""
    docs = spark.createDataFrame([(1, "a b c d", True), (2, "e f", False), (3, None, False)], "doc_id long, text string, learnt boolean")
    got = {r.doc_id: r for r in pitman_yor.score(docs, F.col("learnt")).collect()}
    d, types, customers = 0.95, 5, 5       # five pairs once, five words in one context each
    p0 = {w: (1 - d + (1 + d * 5) / (types + 1)) / (1 + customers) for w in ("a", "b", "c", "d", None)}
    unknown = (1 + d * 5) / (types + 1) / (1 + customers)
    once = {w: (1 - d + (1 + d) * p) / 2 for w, p in p0.items()}
    assert math.isclose(got[1].score, sum(math.log10(once[w]) for w in once), rel_tol=1e-6)
    start = (1 + d) / 2     # of the parent's share after a start that was followed once, by another word
    assert math.isclose(got[2].score, math.log10(start * unknown) + math.log10(unknown) + math.log10(p0[None]), rel_tol=1e-6)
    assert math.isclose(got[3].score, math.log10(start * p0[None]), rel_tol=1e-6)


@pytest.mark.parametrize("settings", [pitman_yor.Settings(), pitman_yor.Settings(block_chars=20_000, sliced=64, frequent=50)])
def test_language_model(spark, odd, settings):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(False))
    for df in (docs, odd):
        rows = df.collect()
        c = Counter(w for r in rows if r.doc_id is not None and crc(str(r.doc_id)) % 5 != 1 for w in tokens(r.text))
        n, v = sum(c.values()), len(c)
        want = Counter((r.doc_id, len(tokens(r.text)), sum(w in c for w in tokens(r.text)), n,
                        round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r.text)), 6)) for r in rows)
        got = pitman_yor.score(df, train, settings=settings).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
        if df is docs:
            held = [r for r in got if not r.learnt]
            assert sum(r.score for r in held) > 1.15 * sum(r.base_score for r in held)     # both negative; held out, less by a sixth
            again = {r.doc_id: r.score for r in pitman_yor.score(df, train, settings=settings).collect()}
            assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-9) for r in got)
    assert pitman_yor.score(docs.limit(0), train).count() == 0
    assert all(abs(r.score) + abs(r.base_score) < 1e-9 for r in pitman_yor.score(docs.limit(3), F.lit(False)).collect())


def test_predictions_sum_to_one():
    """Over all words and the unknown one, for a context and for the parent."""
    s, d, c = pitman_yor.Settings(), 0.7, np.array([5, 1, 2, 0, 0])
    t = pitman_yor.Totals(tokens=8, types=5)
    seats, up = np.array([2, 1, 1, 0, 0]), np.array([3, 1, 2, 4, 1])
    parent = pitman_yor.Parent(1, int(up.sum()), 7, d, {})
    p0 = parent.p0(np.r_[up - d * np.array([2, 1, 1, 2, 1]), 0.0], t, s)
    assert math.isclose(p0.sum(), 1)
    assert math.isclose(pitman_yor.predictive(np.r_[c, 0], np.r_[seats, 0], c.sum(), seats.sum(), p0, d, s.strength).sum(), 1)


def test_new_queries(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name in ("op11_merkle_manifest", "op13_spelling_variants"):
        got = registered.QUERIES[name](spark, SF)
        at = con.execute(registered.ORACLES[name])
        names = [x[0] for x in at.description]
        assert Counter(map(tuple, got.select(*names).collect())) == Counter(at.fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def damage(i, w):
        h = crc(f"{i}:{w}")
        return w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w
    assert sorted(map(tuple, registered.op13_spelling_variants(spark, SF).collect())) == brute_variants([(r.doc_id, r.text) for r in docs], damage)
    got = registered.op12_pitman_yor(spark, SF)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {r.doc_id for r in got.filter("held_out").collect()} == {r.doc_id for r in docs if crc(str(r.doc_id)) % 5 == 1}


def test_inner_names_stay(spark):
    """Columns named like the operators' own come back with their values."""
    inner = ("_class", "_again", "_id", "_x", "_y", "_text", "_doc", "_rank", "_size", "_c", "_u", "_source", "_from", "_whole", "_row", "_part",
             "_one", "_curve", "_t0", "_shard", "_slot", "_passes", "_r0", "_s0", "_p", "_made", "curve_curve")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in inner])
    for got in (ngram_join.first_of_each(named), mixing.mix(named), sharding.shard(named, ["lang", "n_chars"], ["doc_id"])):
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in inner)
        assert [c for c in got.columns if c in named.columns] == named.columns


def test_labelled_sample_is_bounded(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(docs.filter("doc_id = 7").select("doc_id", F.explode(F.array_repeat("text", 20_000)).alias("text")))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    labels = labels.union(labels.filter("doc_id = 7").select("doc_id", F.explode(F.array_repeat("toxic", 20_000))))
    got = common.labelled(docs, labels, "toxic", "text", "doc_id", 1000).collect()
    assert sorted((r._id, r._text, r._y) for r in got) == sorted((k, f"text {k}", k % 2) for k in range(400))
    few = common.labelled(docs, labels, "toxic", "text", "doc_id", 100).collect()
    assert len(few) == len({r._id for r in few}) and 50 < len(few) < 150
    assert toxicity.learn(docs, labels) == toxicity.learn(docs.dropDuplicates(), labels.dropDuplicates())
    assert line_crf.learn(docs, labels, "toxic") == line_crf.learn(docs.dropDuplicates(), labels.dropDuplicates(), "toxic")


def test_ids_of_every_letter():
    from tokenizers import Tokenizer
    words = packing.Words(packing.Settings().path())
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    tok = Tokenizer.from_file(packing.Settings().path())
    for before in ("", "a"):
        for k, mark in enumerate(["", *packing.MARKS]):
            own = letters[k % 3::3]
            for i in range(0, len(own), 2000):
                parts = [before + c + mark for c in own[i:i + 2000]]
                want = np.array(tok.encode(" ".join(parts), add_special_tokens=False).ids, "<u4").tobytes()
                assert b"".join(words.encode_all(parts)) == want


def test_other_vocabulary_is_read_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["it's DON'T a.b,c", "two  spaces and\nlines İ.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(df, settings=packing.Settings(vocabulary=path)).collect():
        ids = np.array(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_words_met_again_are_not_encoded_again():
    """A word of every text stays, however many others come and go; ids are those of the tokenizer, and what is held is bounded."""
    class Counted(packing.Words):
        asked = []

        def encode_all(self, parts):
            self.asked += parts
            return super().encode_all(parts)

    from tokenizers import Tokenizer

    words, tok = Counted(packing.Settings().path(), limit=40), Tokenizer.from_file(packing.Settings().path())
    for k in range(30):
        text = "Common word, " + " ".join(f"{chr(97 + k % 26)}{chr(97 + j)}x{'.' * (j % 2)}" for j in range(20))
        assert list(words.ids([text])) == [np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(words) <= 60 and len(words.older) <= 60 and len(words.bodies) + len(words.older_bodies) <= 160
    assert words.asked.count("Common") == words.asked.count("word,") == 1


def test_words_held_are_looked_up_one_by_one():
    """The generations of words that a worker holds are never gone through, and white space of any kind parts words as the tokenizer does."""
    from tokenizers import Tokenizer

    class Held(dict):
        def __iter__(self):
            raise AssertionError("goes through all words held")

    words, tok = packing.Words(packing.Settings().path()), Tokenizer.from_file(packing.Settings().path())
    words.older, words.older_bodies = Held(), Held()
    texts = ["", " ", "　", " two  words\t\n", "a b c.　d \v\f\r", "\x85e", "f\x1cg h", "<|endoftext|> i", "Kİ l,, .", None]
    for given in (texts, texts * 2, ["i"], [None], []):
        want = [b"" if t is None else np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in given]
        assert list(words.ids(given)) == want
