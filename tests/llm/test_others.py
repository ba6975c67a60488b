"""Codec, sharding, extraction, classifiers, decontamination, pipeline."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import quality, spm_codec, toxicity
from sievework.llm.decontaminate import ItemIndex, add_leaks, shingles, words_of
from sievework.llm.html_extract import extract, extract_text
from sievework.llm.sharding import _level, _quotas, _seats, balanced_shards
from sievework.llm.spm_codec import PieceCodec, decode, default_model, encode, unpack_ids

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return default_model()


@pytest.fixture(scope="module")
def library(model):
    return spm.SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def own(model):
    return PieceCodec(model)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abthe in er\n▁ \t<>x0A中文é😀"), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_codec_equals_library(own, library, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    assert unpack_ids(own.encode_packed(text)) == want and own.decode_packed(own.encode_packed(text)) == library.decode(want)


def test_codec_long_and_pairs(own, library):
    for text in [" " * 70, "a" * 5000, "thethein" * 900, "中文字" * 500, "x" * 200 + " " * 90 + "y", "the in er " * 3000]:
        assert unpack_ids(own.encode_packed(text)) == library.encode(text, add_bos=True, add_eos=True)
    rnd, pieces = random.Random(1), list(own.score)
    for _ in range(5000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        assert own.apart(a, b) == (own.merged(a + b) == [a, b])


def test_codec_searches_units_together(model, library, monkeypatch):
    """Units not met before are searched many at a time, also where the search turns
    back, memo and pair slots overflow, or a character has no code."""
    for name, value in {"TOGETHER": 4000, "MEMO_UNITS": 700, "PAIR_SLOTS": 64, "MEMO_PAIRS": 500}.items():
        monkeypatch.setattr(spm_codec, name, value)
    rnd, codec, alone = random.Random(4), PieceCodec(model), []
    entries = codec._entries
    monkeypatch.setattr(codec, "_entries", lambda unit: alone.append(unit) or entries(unit))
    parts = sorted(p.strip("▁") for p in codec.score if 1 < len(p.strip("▁")) < 5 and p.strip("▁").isalpha())
    words = ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) + rnd.choice(["", "", ",", ".", "!?"]) for _ in range(3000)]
    texts = ["", *(" ".join(rnd.choices(words, k=120)) for _ in range(50)), "a\0b 中文é😀\n\n  x  y▁", "ab" * 90 + " " + words[0]]
    got = list(codec.encode_many(texts))
    assert [unpack_ids(x) for x in got] == library.encode(texts, add_bos=True, add_eos=True)
    assert [codec.decode_packed(x) for x in got[:-2]] == texts[:-2]
    assert len(alone) < len({u for t in texts for u in t.split()}) / 2
    assert codec.unit.findall("▁word,▁word.") == ["▁word", ",", "▁word", "."]


def test_codec_frame(spark, model, library):
    got = decode(encode(frame(spark), model), model).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert unpack_ids(r["ids_le"]) == library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["decoded"] == (r["text"] or "")


def test_sharding(spark):
    rnd = random.Random(6)
    texts = ["hot " * 30] * 600 + [f"copy {k % 90} " + "y" * (k % 90) for k in range(400)] + [f"single {k} " + "z" * rnd.randint(0, 300) for k in range(900)] + [None, "", "", "w" * 4000]
    rows = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    got = balanced_shards(frame(spark, rows), 10, fill_buckets=16, slot_buckets=4).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    load, slots = Counter(), {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 10
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(10))
    apart = Counter()
    for r in got:
        if (texts[r["doc_id"]] or "").startswith("copy"):
            apart[texts[r["doc_id"]], r["shard"]] += 1
    assert sum(c * c for c in apart.values()) > 0.7 * 400 * 400 / 90  # copies mostly lie together
    assert balanced_shards(frame(spark, []), 10).count() == 0


def test_sharding_cuts_only_what_has_no_room(spark):
    texts = ["half " * 800] * 4 + ["third " * 700] * 3 + ["large " * 9] * 700 + [f"single {k} " * 20 for k in range(600)]
    rows = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    got = balanced_shards(frame(spark, rows), 10).collect()
    room, held, load = sum(r["size"] for r in got) / 10, {}, Counter()
    for r in got:
        held.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        load[r["shard"]] += r["size"]
    assert {len(held["half " * 800]), len(held["third " * 700])} == {1}
    assert len(held["large " * 9]) <= -(-700 * (54 + 16) // room) + 1
    assert max(load.values()) < 1.05 * room
    assert _seats([(b"a", 60), (b"b", 250)], 4, 100.0) == {b"b": [(0.4, 0), (0.8, 1), (1.0, 2)], b"a": [(1.0, 3)]}


def test_sharding_parts():
    assert _level([1.0, 5.0, 3.0], 3.0) == [2.5, 0.0, 0.5]
    grant = _quotas({(0, 1): 10, (1, 0): 4}, {0: 12, 1: 8}, 10, 2)
    assert 8 + 10 * grant[0, 1] - 4 * grant[1, 0] <= 10 + 1e-3


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header>Site <b>name</b></header><nav><ul><li><a href=/a>a</a></li></ul></nav>{cookie}"
    "<div id='wrap'><div class='{content}'><h1>Head &amp; line</h1><p>First paragraph with <b>in</b>line and enough words to count as text.<p>Un.</p><script>var x='</p>'</script>"
    "<ul><li>item one of the list</li><li>two</li></ul><p>Last paragraph &#233;t&eacute;,<br>also with a good number of words in it.</p></div>"
    "<div class='comments'><p>A reader says something quite long here, which is no part of the article at all.</p></div><aside>Read also: more</aside></div>"
    "<form><input><button>Send</button></form><footer>&copy; owner</footer></body></html>"
)
WANT = "Head & line First paragraph with inline and enough words to count as text. Un. item one of the list two Last paragraph été, also with a good number of words in it."


def test_html(spark):
    assert extract_text(PAGE.replace("{cookie}", "<div class='cookie-banner'>We use cookies for your convenience.</div>").replace("{content}", "post-body")) == WANT
    article = PAGE.replace("{cookie}", "").replace("<div class='{content}'>", "<article>").replace("</div><div class='comments'>", "</article><div class='comments'>")
    assert extract_text(article) == WANT
    assert [extract_text(x) for x in (None, "", " ", "<p>", "plain &lt; text", "<nav>x</nav>")] == ["", "", "", "", "plain < text", ""]
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old")], "page_id int, url string, html string, text string")
    assert [r["text"] for r in extract(pages).orderBy("page_id").collect()][1] == ""
    assert extract(pages.limit(0)).count() == 0


def test_html_pages(spark, sf_dir):
    import html
    import re

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert extract_text(r["html"]) == " ".join(b for b in blocks if b)


def test_quality_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)  # only a pair tells
    model = quality.fit(x[:2000], y[:2000], rounds=40)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9 and (0, 1) in model.pairs
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert quality.fit(x[:5], np.ones(5)).score(x[:1])[0] > 0.5
    assert not quality.features(None).any() and np.isfinite(quality.features("\n")).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)


def test_classifiers_awkward(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels)
    assert got.count() == len(corpus()) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.toxicity(docs, model).count() == len(corpus())
    none = toxicity.fit_toxicity(docs.limit(0), labels)
    assert toxicity.toxicity(docs, none).where("toxic").count() == 0
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 4 <> 2"))
    rows = toxicity.toxicity(docs.where("doc_id % 4 = 2"), model).join(labels.withColumnRenamed("toxic", "mark"), "doc_id").collect()
    found = sum(r["toxic"] for r in rows if r["mark"]) / sum(r["mark"] for r in rows)
    assert found > 0.85 and sum(r["toxic"] for r in rows if not r["mark"]) <= 0.01 * len(rows)


@pytest.mark.parametrize("clean_for_toxic", [1.0, 0.4])
def test_toxicity_balanced_labels(spark, clean_for_toxic):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = labels.where("toxic = 1")
    few = labels.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(int(toxic.count() * clean_for_toxic))
    labels = toxic.unionByName(few).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 4 <> 2"))
    rows = toxicity.toxicity(docs.where("doc_id % 4 = 2"), model).join(labels.withColumnRenamed("toxic", "mark"), "doc_id").collect()
    hits = sum(r["toxic"] for r in rows if r["mark"])
    assert len(model.index) > 0 and hits > 0.85 * sum(r["mark"] for r in rows) and hits > 0.95 * sum(r["toxic"] for r in rows)


def test_chain_folds_see_no_label_of_their_own():
    """Feature 1 is the mark itself, but only the view of all rows has it: out-of-fold
    inputs of the second model must not know it."""
    rng = np.random.default_rng(4)
    y = rng.random(600) < 0.5
    marks = np.column_stack([y, y])
    without, full = [np.array([0])] * 600, [np.array([0, 1] if t else [0]) for t in y]
    chain = toxicity.fit_chain([(without, marks)] * 5 + [(full, marks)], np.arange(600) % 5, 2)
    assert chain[0][1] > 1 and chain[1][2] < 1  # what is left is the share of the other folds, which speaks against the own


def test_classifiers_replace_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}", -7.0, "x", k) for k in range(20)], "doc_id long, text string, score double, toxic string, _chain int")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit_toxicity(docs, labels))
    assert got.columns == ["doc_id", "text", "_chain", "score", "toxic", "p_dense", "p_sparse"]
    assert all(0 <= r["score"] <= 1 and r["_chain"] == r["doc_id"] for r in got.collect())
    got = quality.quality_scores(docs, labels)
    assert got.columns == [*docs.columns, "held_out", "predicted"] and all(0 <= r["score"] <= 1 and r["toxic"] == "x" for r in got.collect())


def test_chain_feeds_forward():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(800)]
    first = np.array([0 in r for r in rows])
    marks = np.column_stack([first, first & np.array([1 in r for r in rows])])
    chain = toxicity.fit_chain([(rows, marks)] * 6, np.arange(800) % 5, 6)
    assert len(chain[0]) == 7 and len(chain[1]) == 8 and chain[1][6] > 0
    p = toxicity.apply_chain(chain, rows, 6)
    assert ((p > 0.5) == marks).mean() > 0.97


def test_leaks(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 60
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, f"{prose(rnd.randint(6, 30))}? {prose(rnd.randint(2, 9))}.") for k in range(60)]
    docs = []
    for k in range(150):
        t = prose(rnd.randint(0, 400))
        if k % 3 == 0:
            t += " " + items[k % 60][1].upper().replace(" ", "\n", 3) + " " + prose(50)
        if k % 7 == 0:
            w = items[(k + 9) % 60][1].split()
            t += " " + " ".join(w[: len(w) // 2])
        docs.append((k, t))
    index = ItemIndex(items)
    grams = {i: shingles(words_of(t)) for i, t in items}
    for k, t in docs:
        w = words_of(t)
        got = {h["item_id"] for h in index.leaks(t)}
        sure = {i for i, g in grams.items() if len(g & shingles(w)) >= 0.8 * len(g) and len(words_of(dict(items)[i])) >= 10}
        assert sure <= got and all(len(grams[i] & shingles(w)) >= 0.3 * len(grams[i]) for i in got), k
    bench = spark.createDataFrame([*items, (99, None), (None, "x"), (100, " ")], "item_id long, text string")
    one = {r["doc_id"]: r["leaks"] for r in add_leaks(spark.createDataFrame(docs, "doc_id int, text string"), bench).collect()}
    many = {r["doc_id"]: r["leaks"] for r in add_leaks(spark.createDataFrame(docs, "doc_id int, text string"), bench, part_bytes=2000).collect()}
    assert {k: [x["item_id"] for x in v] for k, v in one.items()} == {k: [h["item_id"] for h in index.leaks(t)] for k, t in docs}
    assert all(x["item_id"] in {y["item_id"] for y in many[k]} for k, v in one.items() for x in v if x["overlap"] == 1.0)
    assert add_leaks(frame(spark), bench).columns == frame(spark).columns
    assert add_leaks(frame(spark), bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_leaks_alike_in_parts(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(200)] + ["the", "of", "and"] * 40
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, f"{prose(rnd.randint(6, 30))}? {prose(rnd.randint(2, 9))}.") for k in range(60)] + [(60, f"{prose(150)}. {prose(9)}.")]
    docs = []
    for k in range(200):
        q, a = items[k % 60][1].split("?")
        if k % 2:
            docs.append((k, f"{prose(30)} {q}. {prose(k % 120)} {a} {prose(60)}"))  # question and answer apart
        else:
            w = f"{q} {a}".split()
            docs.append((k, f"{prose(90)} {' '.join(w[: len(w) * (80 + k % 21) // 100])} {prose(40)}"))  # a part of the item
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    one = {r["doc_id"]: r["leaks"] for r in add_leaks(frame, bench).collect()}
    assert sum(map(len, one.values())) > 50
    assert {r["doc_id"]: r["leaks"] for r in add_leaks(frame, bench, part_bytes=1500).collect()} == one


def test_leaks_of_every_item(spark):
    texts = [" ".join(f"{w}{k}" for k in range(12)) + f"? The answer {w} is right." for w in ("alpha", "beta", "gamma", "delta")]
    bench = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (0, texts[1]), (None, texts[2]), (None, texts[3]), (1, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before it {t} after it") for k, t in enumerate(texts)], "doc_id int, text string")
    for size in (8 << 20, 60):
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in add_leaks(docs, bench, part_bytes=size).collect()}
        assert got == {0: [0], 1: [0], 2: [None], 3: [None]}


def test_pipeline(spark, sf_dir):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("NOT round_trip").count() == 0
    got = corpus_pipeline.run(spark, sf_dir)
    n = got.count()
    assert 100 < n < 200 and got.where("n_tokens < 2").count() == 0
    leaked = corpus_pipeline.decontaminated(spark, got, sf_dir)
    assert leaked.count() == n
    assert SCHEMA.startswith("doc_id")


def test_html_regions():
    long = "A paragraph that is much longer than all the others of this page, so that it holds most of its characters by far and wide."
    assert extract_text(f"<body><p>{long}</p><p>Short.</p><div class='sideBar'>x y</div></body>") == f"{long} Short."
    assert extract_text(f"<p>{long}<p>Short.") == f"{long} Short."
    assert extract_text(f"<div id=a><blockquote>{long}</blockquote><p>Short.</p></div><div class='side-bar'>more</div>") == f"{long} Short."
    assert extract_text(f"<main><h2>T</h2><p>{long}</p><div class=ad>Buy</div><p>End</p></main><div><p>{long} elsewhere</p></div>") == f"T {long} End"


def test_html_region_of_all_blocks():
    long = " ".join(f"Sentence {k} of a block that holds most of this page." for k in range(14))
    more = " ".join(f"Sentence {k} of its sibling block." for k in range(9))
    for tag in ("div", "section"):
        blocks = f"<{tag}>{long}</{tag}><{tag}>{more}</{tag}><{tag}>Un.</{tag}>"
        assert extract_text(f"<body><div class=post>{blocks}</div></body>") == f"{long} {more} Un."
    assert extract_text(f"<table><tr><td>{long}<td>{more}</table>") == f"{long} {more}"
    assert extract_text(f"<div id=a><div><p>{long}</p><p>b</p></div><div><p>{more}</p></div></div>") == f"{long} b {more}"
    assert extract_text(f"<div id=a><div><p>{long * 9}</p><p>b</p></div><div><p>{more}</p></div></div>") == f"{long * 9} b {more}"
    assert extract_text(f"<div id=a><article><p>{long}</p></article><article><p>{more}</p></article></div>") == f"{long} {more}"


def test_html_teaser_articles():
    paragraphs = [" ".join(f"Sentence {k} of paragraph {n} in a plain element." for k in range(6)) for n in range(8)]
    body, teaser = "".join(f"<p>{p}</p>" for p in paragraphs), "A teaser that is some sentences of a good length and leads elsewhere. " * 4
    for teasers in (f"<article>{teaser}</article>", f"<div id=more><article>{teaser}</article><article>{teaser}</article></div>", f"<article class=comment>{teaser}</article>"):
        got = extract_text(f"<body><div id=x>{body}<p>End.</p></div>{teasers}</body>")
        assert got.startswith(" ".join(paragraphs) + " End.")


def test_html_layout_wrappers():
    text = " ".join(f"Sentence {k} of the article inside a wrapper." for k in range(12))
    more = " ".join(f"Sentence {k} by a reader." for k in range(9))
    beside = f"<div class=comments><p>{more}</p></div><div class='side-bar'><p>Read also what others read, it is very long, too.</p></div><div>Site name</div>"
    for name in ("page no-sidebar", "has-sidebar", "header-fixed content", "post tags-enabled", "legal-news", "search"):
        for inner in (f"<p>{text}</p><p>Un.</p>", f"<article><p>{text}</p><p>Un.</p></article>", f"<main><p>{text}</p><p>Un.</p></main>"):
            assert extract_text(f"<body><div class='{name}'>{inner}</div>{beside.replace('<div>Site name</div>', '')}</body>") == f"{text} Un.", name
        assert text in extract_text(f"<body><div class='{name}'><div id='header-fixed'><p>{text}</p></div>{beside}</div></body>"), name
        assert more not in extract_text(f"<body><div class='{name}'><div><p>{text}</p></div>{beside}</div></body>"), name
    assert extract_text(f"<body><form id=aspnetForm><div><p>{text}</p><p>Un.</p></div></form></body>") == f"{text} Un."
    assert extract_text(f"<body><div><p>{text}</p></div><form><p>Write to us, we like it when you do, really.</p></form></body>") == text


def test_html_inline_suspects():
    text = " ".join(f"Sentence {k} of a paragraph." for k in range(9))
    assert extract_text(f"<div><p>{text} <span class=notice>Mind <span>this</span> now</span> and <a class='social' href=/>that</a>.</p></div>") == f"{text} Mind this now and that."
    assert extract_text(f"<div><p>{text}</p><p><a class=social>Tweet</a> <a class=share>Send</a></p><p>wor<span hidden>x</span>d</p></div>") == f"{text} word"


def test_html_comment_articles():
    text, more = (" ".join(f"Sentence {k} {by}." for k in range(n)) for by, n in (("of the author", 20), ("of a reader", 60)))
    assert extract_text(f"<body><div id=x><p>{text}</p></div><div><article class=comment><p>{more}</p></article></div></body>") == text


def test_html_comments_are_never_the_article():
    more = " ".join(f"Sentence {k} of a reader." for k in range(30))
    for name in ("comment-section", "comments", "userReplies", "disqus_thread comments-open"):
        assert extract_text(f"<body><div class='{name}'><p>{more}</p></div></body>") == ""
        assert extract_text(f"<body><div class='{name}'><article>{more}</article><article>{more}</article></div></body>") == ""
        assert extract_text(f"<body><h1>Head</h1><div class='{name}'><p>{more}</p></div></body>") == "Head"
    text = " ".join(f"Sentence {k} of the author." for k in range(20))
    assert extract_text(f"<body><div class='related-layout'><article><p>{text}</p><p>Un.</p></article></div></body>") == f"{text} Un."
    assert extract_text(f"<body><article class='post comment-open'><p>{text}</p><p>Un.</p></article></body>") == f"{text} Un."


def test_html_thread_beside_an_article():
    short = [f"Paragraph {k} of the article, which is a short one." for k in range(5)]
    article, words = "".join(f"<p>{p}</p>" for p in short), " ".join(f"Sentence {k} of a thread." for k in range(7))
    for one in ("<li class=c>{}</li>", "<li>{}</li>", "<div class=c><p>{}</p></div>"):
        for around in ("<ol class='thread'>{}</ol>", "<section><h2>Answers</h2>{}</section>"):
            page = f"<body><article>{article}</article>{around.format(''.join(one.format(words) for _ in range(9)))}</body>"
            assert extract_text(page) == " ".join(short), one
    lists = "".join(f"<li>{words}</li>" for _ in range(6))
    assert words in extract_text(f"<body><article><p>{short[0]}</p><ul>{lists}</ul></article></body>")


@pytest.mark.parametrize("opened", ["<div>", "<div class=sidebar>", "<main>", "<span class=notice>"])
def test_html_unclosed_nesting_is_linear(opened):
    def seconds(n):
        start = time.process_time()
        extract_text(f"{opened}some words " * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40000) < 20 * max(seconds(4000), 0.05)
    if opened == "<div>":
        assert extract_text(f"{opened}some words " * 3000) == " ".join(["some words"] * 3000)


def test_html_frame_awkward(spark):
    schema = "page_id int, html string, block string"
    twice = extract(spark.createDataFrame([(1, "<p>a &amp; b</p>", "x")] * 2, schema)).collect()
    assert [(r.text, r.block) for r in twice] == [("a & b", "x")] * 2
    assert extract(spark.createDataFrame([], schema)).count() == 0
