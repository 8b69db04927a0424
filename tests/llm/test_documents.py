"""Each text operator on documents with nulls, empty and long texts, ties, repeated rows and clashing columns, and against brute force."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import (
    fertility, html_text, impact_search, language, line_crf, mixing, ngram_join, packing, sharding, toxicity)
from lithoframe.llm import queries as registered

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, size string, copies string, _class string"


def rows(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}" if i % 4 else None, None, "x", None, "y", "z", "c")
            for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, one word, a very long text, repeated rows, a null id, and columns named like results."""
    rng = np.random.default_rng(1)
    prose = " ".join(f"w{k}" for k in rng.integers(0, 500, 300))
    long = "\n".join(" ".join(f"v{k}" for k in rng.integers(0, 900, 12)) for _ in range(2000))
    made = rows([None, "", " \n\t", "one", "a b c d", prose, prose, prose + " tail", long, "!!! ### $$$", "é" * 50, "日本 語"])
    made += [made[5], made[5], (None, prose, None, None, None, None, None, None, None, None), (None, None) + (None,) * 8]
    return spark.createDataFrame(made, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def brute_groups(texts: dict, t=0.8):
    sets = {}
    for i, x in texts.items():
        w = WORDS.findall(x or "")
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    links = Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            holders[g].add(i)
    for a, b in {p for m in holders.values() for p in itertools.combinations(sorted(m), 2)}:
        if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i in sets}


def test_join_against_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = texts[1].split()
    for k in range(40):  # near copies of one text, more than a block holds
        own = list(base)
        own[k % len(own)] = f"changed{k}"
        texts[10_000 + k] = " ".join(own)
    df = docs.sparkSession.createDataFrame(list(texts.items()), "doc_id long, text string")
    small = ngram_join.Settings(block=16, group_block=8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_similar(df, settings=small).collect()}
    assert got == brute_groups(texts)
    stays = sorted(r.doc_id for r in ngram_join.first_of_each(df, settings=small).select("doc_id").collect())
    assert stays == sorted({c for c, _ in got.values()})


def test_join_on_odd_rows(odd, none):
    got = ngram_join.join_similar(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[0][0].class_id == 0 and by[0][0].n_links == 0 and by[2][0].n_links == 0
    assert len(by[5]) == 3 and all(r.class_id == 5 and r.n_copies == 5 and r.n_texts == 1 and r.n_links == 5 for r in by[5])
    assert by[7][0].class_id == 5 and by[7][0].n_links == 5
    kept = ngram_join.first_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect())[5] == 1
    assert {0, 1, 2, 3, 4, 5, 8, 9, 10, 11} <= {r.doc_id for r in kept.collect()}
    assert not {6, 7} & {r.doc_id for r in kept.collect()}
    assert ngram_join.join_similar(none).count() == 0 and ngram_join.first_of_each(none).count() == 0


def test_dropping_is_by_posterior():
    s = ngram_join.Settings()
    for n, m in ngram_join.least_matches(s):
        draws = np.random.default_rng(n).beta(m, n - m + 2, 20_000) if m else np.zeros(1)  # one match below what is kept
        assert (draws >= s.threshold).mean() < 1e-3


def test_language(spark, docs, odd, none):
    model = language.learn(docs, F.lit(True))
    assert [k for k, _ in model.content] == ["de", "en", "es", "fr"]
    got = language.identify(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in language.identify(odd, model).collect() if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (0, 1, 2, 9))
    empty = language.learn(none, F.lit(True))
    assert empty.content == () and language.identify(none, empty).count() == 0
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(odd, model, prefix="_x_").columns[:len(odd.columns)] == odd.columns


def test_language_sample_counts_copies_once(spark):
    texts = [(f"text number {chr(97 + k % 26)}{chr(97 + k // 26)} of this language", "aa") for k in range(60)]
    texts += [("x" * 50 + " " + chr(97 + k) * 3, "bb") for k in range(20)]     # alike in their first 50 characters
    df = spark.createDataFrame(texts, "text string, lang string")
    first = df.filter("lang = 'aa'").orderBy(F.xxhash64("text")).limit(40).collect()
    copied = df.union(df.filter(df.text == first[0].text).select(F.explode(F.array_repeat("text", 300)), "lang"))
    s = language.Settings(texts_per_language=40, chars_per_text=50)
    want = " ".join(r.text[:50] for r in first).encode()
    for rows_ in (df, copied.repartition(5)):
        assert dict(language.learn(rows_, F.lit(True), settings=s).content) == {"aa": want, "bb": b"x" * 50}


def labelled(docs):
    return docs.sparkSession.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (line_crf, "quality")])
def test_classifiers(spark, docs, odd, none, module, label):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = module.learn(big, labels.filter(~held), label)
    got = module.score(big.join(labels.filter(held), "doc_id"), model).collect()
    pairs = [(a.score, b.score) for a in got for b in got if a[label] == 1 and b[label] == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a, b in pairs]) > (0.85 if label == "toxic" else 0.97)
    scored = module.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(r.predicted == int(r.score >= model.settings.threshold) for r in scored)
    empty = module.learn(none, labels.limit(0), label)
    assert module.score(none, empty).count() == 0 and module.score(odd, empty).count() == odd.count()
    assert module.score(odd, model, prefix="_x_").columns[:len(odd.columns)] == odd.columns


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    node, edge = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    paths = {p: np.exp(sum(node[0, k] * y for k, y in enumerate(p)) + sum(edge[a, b] for a, b in zip(p, p[1:])))
             for p in itertools.product((0, 1), repeat=5)}
    z = sum(paths.values())
    good, pairs, log_z = line_crf.forward_backward(node, edge, np.array([5]))
    assert np.isclose(log_z[0], np.log(z))
    assert np.allclose(good[0], [sum(v for p, v in paths.items() if p[k]) / z for k in range(5)])
    assert np.isclose(pairs[1, 0], sum(v * sum(p[k:k + 2] == (1, 0) for k in range(4)) for p, v in paths.items()) / z)


def brute_fertility(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    twice = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice),
            len(words) < 50 or 100 * len(twice) > 50 * len(words))


def test_fertility(docs, odd, none):
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=fertility.Settings().path())
    for df in (docs, odd):
        for r in fertility.judge(df.select("doc_id", F.col("text").alias("body"), "text"), "body").collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_fertility(r.text)
            assert not (r.base_failed and r.kept)
            if r.n_words < 2000:
                assert r.n_tokens == sum(len(model.encode(w)) for w in WORDS.findall(r.text or ""))
    assert fertility.judge(none).count() == 0
    assert [fertility.script_of(x) for x in ("abc", "été", "привет", "日本語", "123")] == ["latin", "latin", "cyrillic", "cjk", "latin"]


def test_packing(docs, odd, none):
    from tokenizers import Tokenizer
    s = packing.Settings(capacity=64)
    tok = Tokenizer.from_file(s.path())
    strange = docs.sparkSession.createDataFrame(
        [(1, "it's DON'T a.b,c x''s"), (2, "a\x1cb <|endoftext|> c"), (3, "ÀÉ é İ ſ ΣΑΣ ΟΔΟΣ. ²a é, 12345 日本語\u0085z")],
        "doc_id long, text string")
    for df in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), strange):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = packing.pack(df, settings=s).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
        assert set(pieces) == set(texts)
        for i, own in pieces.items():
            ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
            want = [(k, at, len(ids[at:at + 64]), zlib.crc32(ids[at:at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
            assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == want
        for held in sequences.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 64
        assert len(sequences) <= 1.05 * -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(none).count() == 0
    assert packing.pack(odd).groupBy("doc_id", "piece").count().filter("doc_id = 5").first()["count"] == 3


def test_best_fit_takes_the_tightest():
    rng = np.random.default_rng(3)
    bins, rooms = packing.BestFit(100), {}
    for n in sorted(rng.integers(1, 100, 400).tolist(), reverse=True):
        fits = [r for r in rooms.values() if r >= n]
        b, at = bins.put(n)
        assert 100 - at == (min(fits) if fits else 100)
        rooms[b] = 100 - at - n


def test_hilbert_steps_by_one():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        index = sharding.hilbert(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, docs, odd, none, tmp_path):
    for df in (docs, odd):
        got = sharding.shard(df.select("doc_id", "lang", "source", "n_chars", F.lit(1).alias("slot")), ["lang", "source", "n_chars"],
                             ["doc_id"], sharding.Settings(shards=7))
        by = defaultdict(list)
        for r in got.collect():
            by[r.shard].append(r.slot)
        n = df.count()
        assert sum(map(len, by.values())) == n
        assert {len(x) for x in by.values()} <= {n // 7, -(-n // 7)}
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sharding.write_shards(got, str(tmp_path / "out"), sharding.Settings(shards=7))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    assert sharding.shard(none, ["lang", "n_chars"], ["doc_id"]).count() == 0


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    w = {x: weights[i % 3] for i, x in enumerate(names)}
    left, open_, goal = float(sum(sizes.values())), {x for x in sizes if sizes[x]}, {x: 0.0 for x in sizes}
    while open_:
        level = left / sum(w[x] for x in open_)
        over = {x for x in open_ if level * w[x] > most * sizes[x]}
        for x in over or open_:
            goal[x] = most * sizes[x] if over else level * w[x]
            left -= goal[x]
        open_ = open_ - over if over else set()
    return goal


def test_mixing(docs, odd, none):
    skewed = docs.withColumn("source", F.when(F.col("doc_id") % 50 == 0, "a").when(F.col("doc_id") % 3 == 0, None).otherwise("b"))
    for df in (docs, skewed, odd):
        got = mixing.mix(df.select("doc_id", "text", "source", F.lit(0).alias("target"))).collect()
        assert len(got) == df.count()
        sizes, taken, goal = Counter(), Counter(), {}
        for r in got:
            assert r["size"] == len(WORDS.findall(r.text or "")) and 0 <= r.copies <= 3
            sizes[r.source] += r["size"]
            taken[r.source] += r.copies * r["size"]
            goal[r.source] = r.target
        want = brute_targets(sizes)
        assert all(np.isclose(goal[x], want[x]) for x in want)
        if df is not odd:
            assert all(taken[x] <= goal[x] + 1e-6 and taken[x] >= 0.9 * goal[x] for x in want)
    again = mixing.mix(skewed.repartition(3)).select("doc_id", "copies")
    assert again.exceptAll(mixing.mix(skewed).select("doc_id", "copies")).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, prefix="_x_").columns[:len(odd.columns)] == odd.columns


def test_mixing_takes_all_that_fits(spark):
    rng = np.random.default_rng(3)
    made = [(k, f"w{k} " * int(2 ** rng.uniform(0, 11)), f"s{k % 12:02}") for k in range(600)]
    df = spark.createDataFrame(made + 3 * made[::5], "doc_id long, text string, source string").repartition(4)
    s = mixing.Settings(weights=(1.0,), share=0.3)
    plan = mixing.allocated(mixing.measured(df, "text", "doc_id", s), "source", s).withColumnRenamed("_source", "source")
    ranked = mixing._expected(mixing.measured(df, "text", "doc_id", s).join(plan, "source"), s)
    alike, left = defaultdict(list), defaultdict(float)
    for r in ranked.collect():
        alike[r.source, r._rank].append(r)
        left[r.source] = r.target
    assert all(r._whole == 0 for group in alike.values() for r in group)
    want = {}
    for (source, _), group in sorted(alike.items()):
        words = sum(r["_size"] for r in group)
        want[group[0].doc_id] = int(words <= left[source])
        left[source] -= words * want[group[0].doc_id]
    got = mixing.mix(df, settings=s).collect()
    assert len(got) == df.count() and all(r.copies == want[r.doc_id] for r in got)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, accept them.</div>{open}<h1>The &lt;head&gt;line &amp; more</h1>
<p>First   paragraph of the
story, with <b>bold</b> words, commas, and enough text to look like prose.<p>Second paragraph, left open, with a
<a href=x>link</a> inside of it and still more words to read.{close}
<div id="comments"><p>Nice article, thanks!</p></div><aside class=sidebar><ul><li><a href=3>Related</a></ul></aside>
<form><input name=q><button>Search</button></form><footer>&copy; Site</footer></body></html>"""
MAIN = ("The <head>line & more\n\nFirst paragraph of the story, with bold words, commas, and enough text to look like prose.\n\n"
        "Second paragraph, left open, with a link inside of it and still more words to read.")


def test_html(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_text.learn(real)
    assert model
    made = [(0, None, "a"), (1, "", "a"), (2, PAGE.format(open="<article>", close="</article>"), "a"),
            (3, PAGE.format(open='<div class="content">', close="</div>"), "a"), (4, "<p>only &am", "a"), (5, "<nav>x</nav>", "a"),
            (6, "<div>" * 3000 + "deep text here" + "</div>" * 3000, "a"), (7, "<a href='x>broken <p>text", "a")]
    df = spark.createDataFrame(made, "page_id long, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df, model).collect()}
    assert got[0].text == got[1].text == got[5].text == "" and got[0].n_chars == 0
    assert got[2].text == got[3].text == MAIN and got[2].n_chars == len(MAIN)
    assert all(got[i].n_chars == len(got[i].text) for i in got)
    plain = {r.page_id: r.text for r in html_text.extract(df, b"").collect()}
    assert plain[2] == MAIN and html_text.learn(df.limit(0)) == b""
    for r in html_text.extract(real, model).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        assert re.sub(r"\s", "", r.text)[:200] in re.sub(r"<[^>]*>|\s", "", article.replace("&amp;", "&").replace("&quot;", '"'))


@pytest.mark.parametrize("source,want", [
    ("<p>Mass <math><mrow><mi>E</mi><mo>=</mo><mn>2</mn><mfrac><mn>3</mn><mn>4</mn></mfrac></mrow></math>.", "Mass E = 2 3 4."),
    ("<p>See<xmp>a <b> &amp; c</xmp>there", "See|a <b> &amp; c|there"),
    ("<head><title>T</title><meta charset=x><p>Body <b>text</b>", "Body text"),
    ("<html><head><noscript><link></head>Body", "Body"),
    ("<head><title>T</title></head><body>Body</body>", "Body"),
    ("<div>a <object data=x>o</div><div>b<object>p</object> c</div>", "a|b c"),
    ("<p>a <span><svg><path><g></span>b</p>c", "a b|c"),
    ("<p>a <svg><text>t<p>b", "a|b"), ("<p>a <svg><title/><text>t</text></svg>b", "a b"),
    *((f"<p>a <{x}>hidden<p>b<div>c</div>d", "a|b|c|d") for x in "audio video canvas noscript select object".split()),
    *((f"<div>a <{x}><i>hidden</i><p>so</p></{x}>b</div>c", "a b|c") for x in "audio video canvas noscript object template".split()),
    ("<p>a <noscript><div><noscript>x</noscript></div>y</noscript>b", "a b"),
    ("<select><option>x<option>y</select>b<!-- </video> --><video><p>c", "b|c")])
def test_html_text_is_not_lost(source, want):
    assert "|".join(html_text.parse(source).text) == want


def test_html_sample_counts_copies_once(spark):
    pages = spark.range(300).select(F.format_string(
        "<article><p>Page %d has words, commas, and a story.</article><nav>menu</nav>", "id").alias("html"))
    s = html_text.Settings(pages=50, trees=2)
    drawn = pages.filter(F.pmod(F.xxhash64("html", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * 50 / 300))
    copied = pages.union(drawn.limit(1).select(F.explode(F.array_repeat("html", 700))))
    for few in (pages, copied.repartition(5)):
        assert html_text.learn(few, settings=s) == html_text.learn(drawn, settings=s)


def test_decoding_has_no_contradiction():
    page = html_text.parse("<div><div><p>a</p><p>b</p></div><ul><li>c</li></ul></div>")
    z = np.array([2.0, 3.0, 4.0, 5.0, -0.1, -6.0, -6.0])[:len(page.tag)]
    kept = html_text.decode(page, z)
    assert "".join(t for k, t in zip(page.at, page.text) if kept[k]) == "ab"


def test_search(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(600, 8)) * 0.3, 2)
    v[100:120] = v[100]
    made = [(i, [float(x) for x in r], "x", "y") for i, r in enumerate(v)]
    made += [(None, [0.1] * 8, "", ""), (700, None, "", ""), (701, [None] + [0.1] * 7, "", ""), (702, [float("nan")] * 8, "", ""),
             (703, [float("inf")] * 8, "", ""), (704, [1.0] * 3, "", "")]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, score string, rank string")
    got = defaultdict(list)
    for r in impact_search.search(df.filter("vec_id % 50 = 0"), df, settings=impact_search.Settings(block=100, queries=5)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = np.floor(256 * np.vstack([v, [1, 1, 1, 0, 0, 0, 0, 0]])).astype(int)
    ids = np.r_[np.arange(600), 704]
    for q in range(0, 600, 50):
        s = whole @ whole[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert sorted(got[q]) == [(k + 1, ids[i], s[i]) for k, i in enumerate(best)]
    assert set(got) == set(range(0, 600, 50))
    assert impact_search.search(df.limit(0), df).count() == 0 and impact_search.search(df, df.limit(0)).count() == 0


def test_search_with_large_components(spark):
    rng = np.random.default_rng(7)
    values = rng.integers(1 << 28, 1 << 29, 8) / 256
    made = [(k, [float(x) for x in rng.permutation(values)]) for k in range(60)] + [(1000, [float((1 << 28) + 1) / 256] * 8)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = impact_search.search(df.filter("vec_id = 1000"), df).collect()
    score = sum(int(256 * x) for x in values) * ((1 << 28) + 1)
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(k + 1, k, score) for k in range(5)]


@pytest.mark.parametrize("factor", [1, 1000])
def test_search_excludes_most_after_half_of_the_postings(spark, factor):
    """A vector is bounded by the open segments of its own, not by those of all dimensions; further steps are right too."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(2000, 32)) * factor / np.sqrt(32)
    whole, s = np.floor(256 * v).astype(np.int64), impact_search.Settings()
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    row = impact_search.build_index(impact_search.as_integers(df, "vec_id", "embedding", s), 32, 1, s).first().asDict()
    block = impact_search.Block(row, 32, float(np.abs(whole).max()))
    assert block.exact.dtype == (np.float32 if factor == 1 else np.float64)
    scored, scores = [], block.scores
    block.scores = lambda at, q: scored.append(len(at)) or scores(at, q)
    for settings in (impact_search.Settings(steps=(0.5,)), impact_search.Settings(enough=0.0)):
        scored.clear()
        for q in range(20):
            ids, best = block.best(q, whole[q], settings)
            all_ = whole @ whole[q]
            assert ids.tolist() == [k for k in np.lexsort((np.arange(2000), -all_)) if k != q][:5] and best.tolist() == all_[ids].tolist()
        assert sum(scored) < 20 * len(v) / 2


def test_search_deals_blocks_evenly(spark):
    """Every slice of queries meets a bundle of blocks in a partition of its own, and queries aren't broadcast for all at once."""
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    found = impact_search.search(df.filter("vec_id % 50 = 0"), df, settings=impact_search.Settings(block=100, queries=5))
    plan, tiles = found._jdf.queryExecution().executedPlan().toString(), 8 * spark.sparkContext.defaultParallelism
    dealt = re.findall(r"direct_shuffle_partition_id\(tile#\d+\), (\d+)\)", plan)
    assert [int(n) for n in dealt] == [min(6, tiles) * min(3, -(-tiles // 6))] * 2 and "SortMergeJoin" in plan and "Broadcast" not in plan
    many = impact_search.search(df.filter("vec_id % 50 = 0"), df, settings=impact_search.Settings(block=max(1, 600 // (3 * tiles)), queries=5))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"direct_shuffle_partition_id\(tile#\d+\), (\d+)\)", plan) == [str(tiles)] * 2
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, found.collect()))


def test_registered_queries(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, registered.op3_impact_search(spark, SF).collect()))
    assert got == sorted(con.execute(registered.ORACLES["op3_impact_search"]).fetchall())
    assert [n.split("_")[0] for n in registered.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in whole.collect()} <= seen
    for df in (odd, odd.limit(0)):
        at = df
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{df.count()}-{k}")
            stage(spark, at, SF).write.parquet(out)
            at = spark.read.parquet(out)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == df.columns


def test_stages_take_few_texts_at_a_time(spark):
    """Batches of the pipeline's stages are bounded in bytes, as they reach Python and as they are read; what is set already stays."""
    import corpus_pipeline

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    seen = lambda: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": [b.nbytes]}) for b in batches), "b long").agg(
        F.max("b"), F.count("*")).first()
    kept = {k: spark.conf.get(k, None) for k in corpus_pipeline.FEW_AT_A_TIME}
    try:
        for _, stage in corpus_pipeline.STAGES:
            for k in kept:
                spark.conf.unset(k)
            stage(spark, docs.limit(0).selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars"), SF)
            assert {k: spark.conf.get(k, None) for k in kept} == corpus_pipeline.FEW_AT_A_TIME
        most, n = seen()
        assert most < 5 << 20 and n > 4
        for k in kept:
            spark.conf.set(k, "77")
        corpus_pipeline.few_at_a_time(lambda spark, docs, sf_dir: docs)(spark, docs, "")
        assert [spark.conf.get(k) for k in kept] == ["77"] * len(kept)
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
