"""The operators on large text against brute force, and on odd input: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from saleslens.llm import (ann, byte_bpe, common, decontaminate, html_extract, quality, sharding, simhash, substring_dedup,
                           token_counts, toxicity)
from saleslens.session import scratch

SPACE = "[\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def prose(rng, n, letters="abcdefghijklm"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Texts with shared passages, near and exact copies, odd spacing, empty ones and a long one."""
    rng = random.Random(4)
    shared, other = prose(rng, 55), prose(rng, 24)
    out = [prose(rng, 60), shared, f"{prose(rng, 12)} {shared} {prose(rng, 9)}", None, "", "   \n\t ", "one two", "ONE  two",
           f"{shared}\n{shared}", f"{prose(rng, 30)}\t{other}", f"{other} {prose(rng, 5)}", "ça für naïve 漢字 " * 30, prose(rng, 4000)]
    near = prose(rng, 300)
    out += [near, near + " tail", near.replace(" ", "  ", 1), near, near.upper()]
    out += [prose(rng, rng.randint(15, 45)) for _ in range(15)]
    out += [" ".join(out[12].split()[k:k + 25 + k % 7]) for k in range(0, 400, 23)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(docs):
    """Columns named like those of results and of steps between."""
    names = ["n_words", "n_removed", "block", "h", "seg", "fp", "component_id", "size", "shard", "slot", "virtual_slot", "digest", "n_tokens",
             "ids", "words", "score", "item_id", "severity", "toxic", "y", "__kept_id", "__bad_id", "text_crc32", "label"]
    return docs.withColumns({n: F.lit("x") for n in names})


def removed(pairs):
    seen, out = set(), {}
    for i, text in pairs:
        words = [w for w in re.split(SPACE, text or "") if w]
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            key = tuple(words[j:j + 20])
            if key in seen:
                gone[j:j + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats_against_all_windows(docs, texts, clashing, empty, spark):
    want = removed(enumerate(texts))
    for table in (docs, clashing):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(table).collect()}
        assert got == want
    assert sum(x[1] for x in want.values()) > 300
    assert substring_dedup.remove_repeats(empty).count() == 0
    twice = substring_dedup.remove_repeats(docs.union(docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in twice} == want and len(twice) == len(want)
    kept = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(docs, texts=True).collect()}
    assert all(hashlib.sha256(" ".join(w for w in re.split(SPACE, kept[i]) if w).encode()).hexdigest() == x[2] for i, x in want.items())


def test_segments_that_differ_share_windows(spark):
    rng = random.Random(8)
    whole = prose(rng, 90).split()
    pairs = [(i, " ".join(whole[a:a + n])) for i, (a, n) in enumerate((rng.randint(0, 60), rng.randint(20, 34)) for _ in range(60))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in substring_dedup.remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == removed(pairs)


def test_shards_have_near_equal_bytes(docs, clashing, texts, empty, spark):
    rows = sharding.shard(clashing, 5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    load = [r.b for r in sharding.shard(many, 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 7 and max(load) - min(load) <= 16 + 96
    assert sharding.shard(empty, 5).count() == 0


def test_map_versions(docs, spark):
    path = scratch(spark)
    sharding.shard(docs, 4, path)
    first, one = sharding.read_map(spark, path)
    sharding.shard(docs, 4, path)
    second, two = sharding.read_map(spark, path)
    assert (first, second) == (2, 3) and one == two and sharding.read_map(spark, path, 1)[1] == sharding.first_map(sharding.SLOTS, 4)
    load = [1 + i % 5 for i in range(400)]
    before = sharding.rebalanced(sharding.first_map(400, 4), load, 4)
    after = sharding.grown(before, load, 4)
    moved = [i for i in range(400) if before[i] != after[i]]
    assert moved and all(after[i] == 4 for i in moved) and abs(sum(load[i] for i in moved) - sum(load) / 5) <= 5


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = prose(rng, 40).split()
        if bad:
            for w in rng.sample(["vileword", "foulterm", "nastyname"], rng.randint(1, 3)):
                text.insert(rng.randint(0, 40), w)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "vileword foulterm nastyname")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_severity_grows_with_evidence(toxic, empty):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.judged(docs, model).collect()}
    wrong = [i for i in range(400) if got[i].toxic != (i % 5 == 0)]
    assert not wrong and got[1002].expected_severity > 1 and not got[1000].toxic and got[1000][1:] == got[1001][1:]
    assert toxicity.judged(empty, model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.judged(docs, nothing).collect())


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    rows = np.repeat(np.arange(300), 3)
    slots = rng.integers(0, 12, 900)
    truth = np.linspace(-2, 2, 12)
    z = np.bincount(rows, weights=truth[slots], minlength=300)
    grades = np.digitize(z, [-1.5, 1.0, 2.5])
    model = toxicity.fit_ordinal(rows, slots, grades, 4, n_slots=12)
    said = model.above(np.bincount(rows, weights=model.weights[slots], minlength=300)).sum(axis=1)
    assert np.mean(np.rint(said) == grades) > 0.85


def components(fps):
    """Smallest row of each component of equal or near fingerprints."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_against_all_pairs(docs, clashing, texts, empty):
    import xxhash

    fps = []
    for text in texts:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = [w for w in re.split(SPACE, lower) if w]
        shingles = [" ".join(words[j:j + 4]) for j in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    want = components(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(clashing).collect()}
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == want and want[14] == 13 == want[17]
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(docs.union(docs)).count() == 2 * len(texts)
    assert sorted(r.doc_id for r in simhash.one_of_each(clashing).collect()) == sorted(set(want))


def test_ball_hashing_finds_every_link(spark):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for d in range(7):
        for base in fps[:40:4]:
            x = base
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.append(x)
    chain = rng.getrandbits(64)
    for k in range(12):
        fps.append(chain ^ ((1 << 4 * k) - 1))
    fps += [0, (1 << 64) - 1]
    fps = list(dict.fromkeys(fps))
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = {r.node: r.component for r in common.connected(simhash.links(table)).collect()}
    want = components(fps)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(int(np.uint64(f).astype(np.int64)))
    for members in groups.values():
        assert {found.get(f, f) for f in members} == {min(members)} or len(members) == 1 and not members & set(found)


def test_test_items_are_found(spark, empty):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(18, 60))) for i in range(40)]
    clean = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(clean)]
    want = set()
    for k in range(0, 40, 3):
        words = clean[k].split()
        at = rng.randint(0, len(words))
        rows.append((1000 + k, " ".join([*words[:at], items[k][1].upper() + ".", *words[at:]])))
        want.add((1000 + k, k))
    half = items[1][1].split()
    rows += [(2000, " ".join(half[:len(half) // 2 + 8])), (2001, None), (2002, ""), (2003, items[5][1].replace(" ", ",\n"))]
    want |= {(2000, 1), (2003, 5)}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    bench = spark.createDataFrame([*items, items[0], (None, "x"), (99, None)], "item_id long, text string")
    got = decontaminate.matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert {r.doc_id for r in decontaminate.without_test_items(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(empty, bench).count() == 0


def test_block_max_wand_gives_all_above_threshold():
    rng = random.Random(9)
    vocabulary = [prose(rng, 1) for _ in range(120)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 20)))) for i in range(150)]
    index = decontaminate.build(items, share=0.3)
    for _ in range(60):
        passage = decontaminate.words_of([" ".join(rng.choice(vocabulary) for _ in range(25))])[0].tolist()
        terms = set(passage)
        scores = {}
        for t in terms & set(index.postings):
            for p, s in zip(*index.postings[t][:2]):
                scores[p] = scores.get(p, 0) + s
        want = {p for p, s in scores.items() if s >= index.needed[p] * (1 - 1e-12)}
        assert {p for p, _ in decontaminate.retrieve(index, terms)} == want


def test_token_counts_against_the_library(docs, clashing, texts, empty, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["<|endoftext|> a <|startoftext|>x", "<|ENDOFTEXT|>", "it's  we'll  x", "a" * 5000, "é ́ x", "1234 !!??", "\x0b\x0c a\x85b"]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)], DOCS)
    cache = scratch(spark)
    every = dict(enumerate(texts)) | {1000 + i: t for i, t in enumerate(odd)}
    table = docs.union(more)
    for _ in range(2):  # from an empty and from a full cache
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table, path, cache).collect()}
        for i, t in every.items():
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert got[i] == (len((t or "").encode()), n, n > 2048), i
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(clashing, path, scratch(spark)).count() == len(texts)
    assert token_counts.count_tokens(empty, path, scratch(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice">We use cookies here</div><header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>First   part<br>of it.
<p>Second &lt;b&gt; &eacute; &#x41;<em>dj</em>oined <a href="/x">link</a></p><ul><li>one long item of the text</li><li>two long items of the text</li></ul></article>
<aside class="sidebar"><a href="/r">Related</a></aside><form><input name=q><button>Go</button></form>
<section class="comments"><div class="comment"><b>Bob</b><p>Nice words from me</p></div></section><footer>&copy; someone</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\n\nFirst part of it.\n\nSecond <b> é Adjoined link\n\none long item of the text\n\ntwo long items of the text"
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "<p>", 0), (5, "u", "<" * 2000 + "a b", 0), (6, "u", "<script>x", 0), (1, "u", PAGE, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_extract.extract(pages).collect()
    assert len(got) == 7
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == want and by_id[1].n_chars == len(want)
    assert by_id[2].text == "" and by_id[3].text == "" and by_id[4].n_chars == 0 and by_id[6].text == ""
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_only_hidden_elements_are_dropped():
    shown = ['class="overflow-hidden"', 'aria-hidden="false"', "data-hidden", 'title="The hidden valley"', "title='a hidden b'", 'data-style="display:none"',
             'title="display: none"', 'style="--display:none"', 'style="display:none;display:block"', 'style="overflow:hidden"', 'style="/* display:none */"',
             'style="visibility:visible" class=hidden', "id=hidden/", 'href="/hidden-gems"', "aria-hidden", "title=hidden"]
    gone = ["hidden", 'HIDDEN=""', 'class="a"hidden', "hidden=until-found", 'aria-hidden="true"', "ARIA-HIDDEN=true", 'style="display:none"', "style='color:red; DISPLAY : none !important'",
            "style=display:none", 'style="display:none!important;display:block"', 'style="display&#58;none"', 'title="x>y" hidden', 'style="display:block;display:none"']
    for raw, want in [(r, False) for r in shown] + [(r, True) for r in gone]:
        assert html_extract.parse(f"<div {raw}>x</div>")[1].hidden == want, raw
    model = html_extract.train(html_extract.labelled_pages())
    article = PAGE.replace("<article>", '<div class="overflow-hidden"><article>').replace("</article>", "</article></div>")
    link = PAGE.replace('<a href="/x">', '<a href="/hidden-gems" title="The hidden valley">')
    want = html_extract.main_text(PAGE, model)
    assert "Adjoined link" in want and html_extract.main_text(article, model) == want == html_extract.main_text(link, model)


def test_marginals_against_all_labellings():
    model = html_extract.train(html_extract.labelled_pages(60))
    nodes = html_extract.parse("<body><nav><a>x</a></nav><article><p>some words here</p></article></body>")
    own = html_extract.evidence(nodes)
    total, on = 0.0, [0.0] * len(nodes)
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        s = model.root[y[0]] + sum(model.local(own[i])[y[i]] for i in range(len(nodes))) + sum(
            model.step(nodes[nodes[i].parent])[y[nodes[i].parent]][y[i]] for i in range(1, len(nodes)))
        p = np.exp(s)
        total += p
        for i in range(len(nodes)):
            on[i] += p * y[i]
    assert np.allclose(html_extract.marginals(nodes, own, model), np.array(on) / total)


def test_content_of_unseen_layouts():
    model = html_extract.train(html_extract.labelled_pages())
    good = total = 0
    for page, _ in html_extract.labelled_pages(80, seed=77):
        nodes = html_extract.parse(page)
        text = html_extract.main_text(page, model)
        inside = [False] * len(nodes)
        marks = re.sub(r'data-main="(\w+)"', r'role="zz\1"', page)
        for i, n in enumerate(html_extract.parse(marks)):
            inside[i] = "zzyes" in n.marks or i > 0 and inside[n.parent] and "zzno" not in n.marks and not n.hidden
            if n.tag == "#text" and len(n.text.strip()) > 12 and n.parent > 0:
                total += 1
                good += inside[i] == (" ".join(n.text.split()) in text)
    assert good / total > 0.93


def test_encoding_against_the_library(docs, clashing, texts, empty, spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})
    odd = [" x　 y\u0085z", "x" * 700, "ab" * 4000, "<|endoftext|>", "  \n\n  don't I'LL 12 3", "\U0001f600\U0001f468‍\U0001f469", "\x1c\x1d a"]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)], DOCS)
    every = dict(enumerate(texts)) | {1000 + i: t for i, t in enumerate(odd)}
    ids = {i: library.encode_ordinary(t or "") for i, t in every.items()}
    encoded = byte_bpe.encode(docs.union(more), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in encoded.collect()} == ids
    assert {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode(encoded, RANKS).collect()} == {i: t or "" for i, t in every.items()}
    for r in byte_bpe.digests(docs.union(more), RANKS, public_tokenizers.PATTERN).collect():
        assert r[1:] == (len(ids[r.doc_id]), hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest(),
                         hashlib.sha256((every[r.doc_id] or "").encode()).hexdigest())
    assert byte_bpe.digests(clashing, RANKS, public_tokenizers.PATTERN).count() == len(texts)
    assert byte_bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    native = byte_bpe.encode_native(docs.limit(12).union(more.filter("length(text) < 100")), RANKS, public_tokenizers.PATTERN).collect()
    for r in native:
        assert (r.ids, r.n_tokens, bytes(r.decoded).decode()) == (" ".join(map(str, ids[r.doc_id])), len(ids[r.doc_id]), every[r.doc_id] or "")


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        lines = [prose(rng, rng.randint(3, 25)).capitalize() + "." for _ in range(rng.randint(1, 8))]
        bad = i % 4 == 1
        if bad:
            kind = rng.randint(0, 2)
            lines = [" ".join(w + ("###", "!!", " | ")[kind] for w in ln.split()) for ln in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (1002, "\n\n\n"), (1003, "one line\n")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_of_held_out_documents(graded, empty):
    docs, labels = graded
    field = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.scored(docs.withColumn("score", F.lit("x")), field).collect()}
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert [i for i in range(300) if got[i].predicted != int(i % 4 != 1)] == []
    assert quality.scored(empty, field).count() == 0
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped)
    assert np.allclose(again.weights, field.weights)  # labels of held-out rows are never seen


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    emit, step, firsts = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, moves, _ = quality.forward_backward(emit, step, firsts)
    want, want_moves = np.zeros(7), np.zeros((2, 2))
    for a, b in zip(firsts[:-1], firsts[1:]):
        total, on, moved = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for bits in range(1 << (b - a)):
            y = [bits >> k & 1 for k in range(b - a)]
            p = np.exp(sum(emit[a + k] * y[k] for k in range(b - a)) + sum(step[y[k - 1], y[k]] for k in range(1, b - a)))
            total += p
            on += p * np.array(y)
            for k in range(1, b - a):
                moved[y[k - 1], y[k]] += p
        want[a:b] = on / total
        want_moves += moved / total
    assert np.allclose(good, want) and np.allclose(moves, want_moves)


def test_lines_of_texts():
    data, offsets = common.flat_texts(__import__("pyarrow").array(["a\nbb\n", "", None, "\n", "ccc"]))
    _, length, firsts = quality.line_statistics(data, offsets)
    assert length.tolist() == [2, 3, 0, 0, 0, 1, 0, 3] and firsts.tolist() == [0, 3, 4, 5, 7, 8]


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[40:60] = x[0]
    odd = [(3000, None), (3020, [0.0] * 16), (3040, [None] * 16), (3060, [float("nan")] * 16), (3080, [float("inf")] * 16), (3100, [])]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(*r, 1) for r in odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    m, hit = x.astype(float), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(f[2] == pytest.approx(float(m[q] @ m[f[1]]), abs=1e-9) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        s = m @ m[q]
        s[q] = -np.inf
        least = np.sort(s)[-20]
        hit += sum(f[2] >= least - 1e-9 for f in found)
    assert hit / (20 * len(got)) >= 0.9
    few = ann.nearest(table.filter("vec_id < 5 or vec_id = 20")).collect()
    assert {r.query_id for r in few} == {0, 20} and len(few) == 10
    assert ann.nearest(table.limit(0)).count() == 0


def test_copies_give_their_smallest_ids(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kind = rng.choice(4, 2400, p=[0.5, 0.3, 0.15, 0.05])  # 0: a vector of its own, otherwise one of three groups of copies
    near = np.flatnonzero((kind == 0) & (np.arange(2400) % 20 == 0))[:20]
    for c in (1, 2, 3):
        x[kind == c] = x[np.flatnonzero(kind == c)[0]]
    x[near] = x[kind == 2][0] + 0.01 * x[near]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in ann.nearest(table, block=32, wanted=0.3).collect():  # groups are wider than the window
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got) == list(range(0, 2400, 20))
    for c in (1, 2, 3):
        ids = np.flatnonzero(kind == c).tolist()
        for q in set(ids) & set(got):
            found = [v for _, v in sorted(got[q])]
            others = [i for i in ids if i != q][:20]
            if c != 2:  # apart from those beside the second group, nothing is as near as a copy
                assert found == others, q
    for q in near.tolist():
        found = [v for _, v in sorted(got[q])]
        copies = [v for v in found if kind[v] == 2]
        assert copies == np.flatnonzero(kind == 2)[:len(copies)].tolist()
        exact = sorted((-sum((a * b for a, b in zip(x[q].tolist(), x[i].tolist())), 0.0), i) for i in range(2400) if i != q)
        assert found == [i for _, i in exact[:20]]


def test_hilbert_curve_is_continuous():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = ann.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_word_helpers_against_split():
    rng = random.Random(1)
    listed = ["", None, "a", " a  b\n", "é ü漢", prose(rng, 300), "\x0b\x0ca"]
    import pyarrow as pa

    data, offsets = common.flat_texts(pa.array(["skip", *listed])[1:])
    starts, ends, firsts = common.word_bounds(data, offsets, common.space_table())
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts, ends)]
    assert words == [w for t in listed for w in (t or "").encode().split()] and firsts[-1] == len(words)
    hashes = common.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    three = common.grams(hashes, 3, 12345)
    assert len(three) == len(words) - 2 and common.grams(hashes[5:8], 3, 12345)[0] == three[5]


def test_dense_cluster_has_few_links(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), 2)))
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = simhash.links(table)
    assert found.count() < 4 * len(fps)
    labels = common.connected(found).collect()
    assert len(labels) == len(fps) and len({r.component for r in labels}) == 1


def test_stars_join_what_links_join():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.integers(0, 60, (2, 40)).astype(np.uint64)
        label = {int(n): int(n) for n in np.concatenate([a, b])}
        for _ in range(60):
            for x, y in zip(a.tolist(), b.tolist()):
                label[x] = label[y] = min(label[x], label[y])
        least, other = simhash._stars(a, b)
        assert dict(zip(other.tolist(), least.tolist())) == {n: c for n, c in label.items() if n != c}
