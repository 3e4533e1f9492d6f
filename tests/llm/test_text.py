"""Toxicity, decontamination, page texts, language model and the pipeline."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from commsim.llm import decontamination, html, katz, simhash, toxicity

PLAIN = "the idea of an online river and stone inside a garden with some trees near water".split()
BAD = ["moron", "idiot", "scum"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(PLAIN) + rng.choice(["", "s", "ing"]) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randint(0, 39)] = rng.choice(BAD)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_noisy_words_are_restored_and_scored(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    assert set(BAD) <= set(model.weights)
    for noisy in ("m0r0n", "i d i o t", "iiiidiot", "1d1ot!", "s.c.u.m", "mor0n$$$", "IDIOT", "sc​um"):
        assert model.score(f"the garden {noisy} and water") > 0.5, noisy
    for clean in (None, "", "the garden of stone", "of%%% the&&& $$$ 12.5.2024 +1 555 1234567", "a b c", "x" * 200_000, "1 " * 50_000):
        assert model.score(clean) < 0.5, clean and clean[:30]


def test_held_out_labels_are_predicted(spark, labelled):
    docs, labels = labelled
    scored = toxicity.score(docs.withColumn("score2", F.lit(1)), toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert scored.where("(score >= 0.5) <> (toxic = 1)").count() == 0


def test_rejection_with_odd_rows(spark, labelled):
    docs, labels = labelled
    more = docs.unionByName(spark.createDataFrame([(None, "you moron"), (None, None), (7000, ""), (1, "repeated row")], docs.schema))
    more = more.withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9))
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (8, 1)], labels.schema))
    kept = toxicity.reject_toxic(more, odd_labels)
    assert kept.columns == more.columns
    assert sorted(r.doc_id for r in kept.where("doc_id > 600 OR text = 'repeated row'").collect()) == [1, 7000]
    assert kept.where("doc_id IS NULL").count() == 1
    assert toxicity.reject_toxic(more.limit(0), odd_labels).count() == 0
    assert toxicity.reject_toxic(more, odd_labels.limit(0)).count() == more.count()


def test_lattice_search_equals_trying_all_readings(spark, labelled):
    model = toxicity.trigram_model(labelled[0])
    for noisy in ("m0r0n", "1!x", "aa00b", "i.d"):
        def all_readings(places, a=0, b=0, score=0.0, text=""):
            if not places:
                yield score + model[a, b, 0], text
                return
            for out, cost in places[0]:
                x, y, total = a, b, score + cost
                for letter in out:
                    code = 0 if letter == " " else toxicity.CODE.get(letter, toxicity.OTHER)
                    total, x, y = total + model[x, y, code], y, code
                yield from all_readings(places[1:], x, y, total, text + out)

        assert toxicity.viterbi(noisy, model) == max(all_readings(toxicity.lattice(noisy)))[1]


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != t)))
    return min(row)


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ([rng.choice("abcd") for _ in range(rng.randint(lo, 90))] for lo in (1, 0))
        assert decontamination.myers(p, t)[0] == edits(p, t)


def test_items_are_found_up_to_the_budget(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]) for i in range(30)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            part = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(part) // 4)):
                at, kind = rng.randrange(len(part)), rng.random()
                part[at : at + (kind < 0.7)] = [] if kind < 0.3 else [rng.choice(vocabulary)]
                if not part:
                    part = ["x"]
            words[len(words) // 2 : len(words) // 2] = part
        docs.append((d, ", ".join(words).upper()))
    docs += [(500, None), (501, ""), (None, " ".join(items[3][1])), (0, docs[0][1])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, ""), (78, None), (None, "a b c")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(-1)).withColumn("hit", F.lit(0))
    want = [(d, i) for d, t in docs for i, w in items if edits(w, decontamination.words_of(t)) <= len(w) // 5]
    got = [(r.doc_id, r.item_id) for r in decontamination.contamination(frame, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 50
    small = [b for b in decontamination.blocks(bench, block_bytes=100)]
    assert len(small) > 3 and sum(map(len, small)) == 31
    unnamed = spark.createDataFrame([(None, "one item without an id of its own")], bench.schema)
    holder = spark.createDataFrame([(1, "it says one item without an id of its own here"), (2, "other")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontamination.contamination(holder, unnamed).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontamination.drop_contaminated(holder, unnamed).collect()] == [2]
    kept = decontamination.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not any(g[0] == d for g in want) for d, _ in docs)
    assert decontamination.contamination(frame.limit(0), bench).count() == 0
    assert decontamination.contamination(frame, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(frame, bench.limit(0)).count() == len(docs)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header>Top</header><h1>A &amp; B&nbsp;{n}</h1><p><b>Bold<br>te</b>xt<p>Second   one
<script>if (a < b) {{ x = "</p>" }}</script><!-- no --><aside>Side</aside><section id="comments"><p>Nice!</section><form><p>Name</form>
<div class="article-body">Third<span> in</span>line</div></article><footer>&copy; 2020</footer></body></html>"""


def test_marked_articles(spark):
    rows = [(1, "http://h/1", PAGE.format(n=1)), (1, "http://h/1", PAGE.format(n=1)), (2, None, None), (None, "", ""), (3, "x", "just text < 3 &lt;b&gt;")]
    rows += [(4, "http://h/4", "<article><p>" + "x y " * 100_000 + "</article>"), (5, "http://h/5", "<div class=ad>no</div><article>yes"), (6, "http://h/6", "<p>open <b>a<p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("y"))
    got = html.main_text(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == "A & B 1 Bold text Second one Third inline"
    assert texts[2] == "" and texts[None] == "" and texts[3] == "just text < 3 <b>" and len(texts[4]) == 399_999 and texts[5] == "yes" and texts[6] == "open a b"
    assert html.main_text(pages.limit(0)).count() == 0


def test_templates_go_inside_and_outside_articles(spark):
    menu, foot = "<div><a href=/>Home</a> <a href=/x>News</a></div>", "<div><p>All rights</p></div>"
    rows = [(i, f"http://site/{i}", f"<body>{menu}<div><p>Own text {i}</p></div>{foot}</body>") for i in range(12)]
    rows += [(100 + i, "http://site/c", f"<body>{menu}<div><p>Copied page</p></div>{foot}</body>") for i in range(40)]
    rows += [(200 + i, f"http://other/{i}", f"<body>{menu}<p>Own text {i}</p></body>") for i in range(3)]
    rows += [(300 + i, f"http://marked/{i}", f"<main><p>Our letter.</p><p>Own text {i}</p></main>{foot}") for i in range(9)]
    rows += [(400 + i, f"http://part/{i}", f"<main>{'<p>Passage.</p>' if i < 4 else ''}<p>Own text {i}</p></main>") for i in range(20)]
    rows += [(500 + i, f"http://edited/{i}", f"<title>One</title><main><p>First part.</p><p>Edit {i}</p></main>") for i in range(30)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(12)) and all(got[100 + i] == "Copied page" for i in range(40))
    assert all(got[200 + i] == f"Home News Own text {i}" for i in range(3)) and all(got[300 + i] == f"Own text {i}" for i in range(9))
    assert all(got[500 + i] == f"First part. Edit {i}" for i in range(30))
    assert all(got[400 + i] == ("Passage. " if i < 4 else "") + f"Own text {i}" for i in range(20))


def test_left_out_elements_win_over_articles(spark):
    story = "The story of the day is long enough."
    pages = {
        1: f'<div class="post">{story}</div><section class="comments"><article class="comment">Nice story, I say</article></section>',
        2: f"<div>{story}</div><aside><article>Read this too</article></aside>",
        3: f'<article class="post">{story}<div class="post-comments"><p>First!</p></div></article>',
        4: f"<div>{story} {story}</div><article>A teaser</article>",
        5: f'<article class="content has-sidebar">{story}</article><div class="content with-comments">more</div>',
    }
    frame = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(frame).collect()}
    assert got == {1: story, 2: story, 3: story, 4: f"{story} {story} A teaser", 5: story}


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<", "</", "<!", "<!--", "<?", "<![CDATA[", "<script ", "<script>", "<div>", "<p><b>", "</p", '<a b="c', "&", "<title"])
def test_broken_markup_is_read_once(piece):
    began = time.perf_counter()
    found = html.Page(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 20 and len(found.blocks) <= 1


def test_deep_markup_is_read_once():
    began = time.perf_counter()
    found = html.Page("<div>x" * 60_000)
    assert time.perf_counter() - began < 20 and len(found.blocks) == 60_000 and len(found.subtrees) == 32


def test_scanner():
    read = lambda text: [x for x in html.markup(text)]
    assert read('a<b c="x>y">d</B >') == [("text", "", "a"), ("open", "b", ' c="x>y"'), ("text", "", "d"), ("close", "b", " ")]
    assert read("1 < 2<br/>") == [("text", "", "1 "), ("text", "", "<"), ("text", "", " 2"), ("open", "br/", "")] or read("1 < 2<br/>")[-1][:1] == ("open",)
    assert read("<script>a<b</SCRIPT>c<!-- x --><!doctype html>") == [("raw", "script", ""), ("text", "", "c")]
    assert read('<a b="c>d<i>e') == [("open", "a", ' b="c'), ("text", "", "d"), ("open", "i", ""), ("text", "", "e")]
    assert read("x<a") == [("text", "", "x"), ("text", "", "<a")]


@pytest.mark.parametrize("tokens, share", [(1 << 21, 1e-4), (3000, 0.02), (3000, 2.0)])
def test_katz_counts_sum_to_one(spark, monkeypatch, tokens, share):
    monkeypatch.setattr(katz, "BATCH_TOKENS", tokens)
    monkeypatch.setattr(katz, "SLOT_TOKENS", max(1000, tokens // 3))
    monkeypatch.setattr(katz, "HEAD_SHARE", share)
    monkeypatch.setattr(katz, "FREQUENT_SHARE", min(share, 0.01))
    rng = random.Random(3)
    words = ["a", "b", "the", "É", "of", *[f"r{i}" for i in range(400)]]
    docs = [(i, " ".join(rng.choice(words[: 5 if rng.random() < 0.7 else 405]).upper() for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(900, None), (901, ""), (None, "a b"), (5, docs[5][1]), (902, "new words\x85only here"), (903, "a " * 100_000), (None, "twin pair " * 9)]
    docs.append((next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1), "twin a twin pair twin never pair"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("words", F.lit(1)).withColumn("row", F.lit(1))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    token_lists = [(i, [*katz.tokens_of(t), katz.END]) for i, t in docs]
    counts = Counter(w for i, ws in token_lists if not held(i) for w in ws)
    total, floor = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    following: dict = {}
    for i, ws in token_lists:
        for b, w in zip([None, *ws], [] if held(i) else ws):
            following.setdefault(b, Counter())[w] += 1
    kept = lambda n, d: n * d[n] if n <= 5 else n
    d = katz.discounts(Counter(counts.values()))
    free = (total - sum(kept(n, d) for n in counts.values())) / total
    p = {w: kept(n, d) / total for w, n in counts.items()}
    prob = lambda w: p.get(w, free)
    d2 = katz.discounts(Counter(n for c in following.values() for n in c.values()))
    share = {}
    for b, c in following.items():
        n_b = sum(c.values())
        shrunk = n_b + (min(c.values()) > 5)
        share[b] = {w: kept(n, d2) / shrunk for w, n in c.items()}
    assert any(min(c.values()) > 5 for c in following.values())
    weight = {b: (1 - sum(ps.values())) / (1 - sum(p[w] for w in ps)) for b, ps in share.items()}

    def after(b, w):
        return share[b][w] if b in share and w in share[b] else weight.get(b, 1.0) * prob(w)

    for b in [*share, "unknown"]:
        assert sum(after(b, w) for w in counts) + after(b, "unknown") == pytest.approx(1)
    got = katz.scored(frame).collect()
    want = []
    for i, ws in token_lists:
        base = sum(math.log10((counts[w] + 0.5) / floor) for w in ws)
        score = sum(math.log10(after(b, w)) for b, w in zip([None, *ws], ws))
        want.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4), round(score, 4)))
    assert sorted(((*r[:5], round(r[5], 4), round(r[6], 4)) for r in got), key=str) == sorted(want, key=str)
    assert katz.scored(frame.limit(0)).count() == 0
    assert [r.score for r in katz.scored(frame.where("doc_id IS NOT NULL AND crc32(cast(doc_id as string)) % 5 = 1")).limit(2).collect()] == [0.0, 0.0]


def test_discounts_keep_their_range():
    assert np.all(katz.discounts({1: 50, 2: 20, 3: 10, 4: 6, 5: 4, 6: 3})[1:] < 1)
    for odd in ({}, {1: 3}, {2: 5}, {1: 1, 6: 9}):
        d = katz.discounts(odd)
        assert np.all((d[1:] > 0) & (d[1:] < 1))


def test_pipeline_keeps_clean_documents(spark, labelled, tmp_path):
    docs, labels = labelled
    rng = random.Random(4)
    item = " ".join(f"q{i}" for i in range(30))
    fresh = lambda n: " ".join(f"v{rng.randint(0, 10_000)}" for _ in range(n))
    extra = [(1000, f"{fresh(50)} {item} {fresh(50)}"), (1001, fresh(80)), (1002, None), (1003, fresh(40) + " password=Zebra77")]
    extra.append((1004, extra[1][1]))
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("lang", F.lit("en"))
    table = table.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).withColumn("n_chars", F.length("text").cast("long"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.score(frame, toxicity.fit(frame, labels)).where("score < 0.5").orderBy("doc_id").collect()
    kept, prints = [], {r.doc_id: simhash.fingerprint_of(r.text) for r in scored}
    low = {i: i for i in prints}  # smallest id reachable, by brute force
    changed = True
    while changed:
        changed = False
        for i, j in combinations(prints, 2):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2 and low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    for r in scored:
        leaked = edits(item.split(), decontamination.words_of(r.text)) <= 6
        kept += [r.doc_id] if low[r.doc_id] == r.doc_id and not leaked else []
    assert ids == kept and {i for i in ids if i >= 1000} == {1001, 1002, 1003}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name


def test_every_operator_is_registered():
    names = set(contract.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
