"""Operators over the whole corpus against brute force: dedup, WARC, extraction, joins, pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from fleetgrain.llm import exact_dedup, html_extract, ngram_join, suffix_dedup, warc
from tests.llm.test_llm_text import frame


def words(rng, n, pool=400):
    return [f"w{rng.randint(0, pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, periodic and empty texts."""
    rng = random.Random(11)
    base, passage = words(rng, 220), " ".join(words(rng, 60))
    texts = [None, "", " ", "a b", "A  B", "a b c", "a b c d", "x" * 99, "x" * 100, "x" * 101, "ab" * 300, "é" * 120, "é" * 120]
    for k in range(70):
        near = list(base)
        for _ in range(k % 9):
            near[rng.randrange(len(near))] = "new"
        texts.append(" ".join(near))
    texts += [f"{' '.join(words(rng, rng.randint(5, 90)))} {passage}" for _ in range(40)]
    texts += [" ".join(words(rng, rng.randint(1, 200), 4000)) for _ in range(60)]
    return texts + [texts[-1]] * 30 + [texts[-2].replace(" ", "\n ")]


def test_exact(spark, corpus):
    rows = exact_dedup.deduplicate(frame(spark, corpus)).collect()
    groups = {}
    for i, t in enumerate(corpus):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {i: (g[0], len(g), i == g[0]) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == want and len(rows) == len(corpus)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_exact_index_outlives_a_batch(spark):
    index = exact_dedup.DigestIndex.fresh(spark, 4)
    first = exact_dedup.ingest(exact_dedup.digests(frame(spark, ["a", "b", "b"])), index)
    again = exact_dedup.ingest(exact_dedup.digests(frame(spark, ["c", "b", "a"])), index)
    assert {r.keep_id for r in first.collect()} == {0, 1}
    assert sorted(r.keep_id for r in again.collect()) == [0, 0, 1] and index.rows().count() == 3
    index.drop()


def brute_suffix(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("stretches", [20_000, 3])
def test_suffix(spark, corpus, monkeypatch, stretches):
    monkeypatch.setattr(suffix_dedup, "BLOCK_STRETCHES", stretches)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    rows = suffix_dedup.deduplicate(frame(spark, corpus), with_kept=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_suffix(corpus)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_suffix_of_rows_without_id(spark):
    rng = random.Random(4)
    passage, alone = " ".join(words(rng, 60)), " ".join(words(rng, 60, 9000))
    rows = [(5, f"five {passage}"), (None, f"{passage} first"), (None, f"{passage} second"), (None, alone), (-9, alone)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()
    assert sorted(r.doc_id is None for r in got) == [False, False, True, True, True]
    kept = {r.doc_id: bytes(r.kept).decode() for r in got if r.doc_id is not None}
    assert kept[5].strip() == "five" and kept[-9] == ""
    nameless = sorted(bytes(r.kept).decode() for r in got if r.doc_id is None)
    assert sum(passage in t for t in nameless) == 1 and alone in nameless and min(map(len, nameless)) < 10


def test_equal_strings():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(1, 9)
        texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 24))) for _ in range(rng.randint(1, 5))]
        found = {}
        for number, text, start in zip(*suffix_dedup.equal_strings(texts, length), strict=True):
            found.setdefault(number, set()).add((int(text), int(start)))
        want = {}
        for t, x in enumerate(texts):
            for p in range(len(x) - length + 1):
                want.setdefault(x[p : p + length], set()).add((t, p))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def sets_of(texts):
    out = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_ngram_join(spark, corpus):
    rows = ngram_join.join(frame(spark, corpus)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(sets_of(corpus)) and len(rows) == len(corpus)


def test_ngram_join_of_rows_without_id(spark):
    rng = random.Random(8)
    base = words(rng, 120)
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in (20, 70, 110)]
    far = [" ".join(words(rng, 90, 9000)) for _ in range(3)]
    rows = [(7, near[0]), (None, " ".join(base)), (4, near[1]), (None, near[2]), (None, far[0]), (None, far[0].upper()), (3, far[1]), (3, far[2]), (None, None), (9, "")]
    got = ngram_join.join(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int")).collect()
    want = [(7, 4), (None, 4), (4, 4), (None, 4), (None, None), (None, None), (3, 3), (3, 3), (None, None), (9, 9)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.component_id)) for r in got)


def test_ngram_join_of_a_group_below_the_threshold(spark, monkeypatch):
    """Copies of one text with four to seven words changed: most of them do not link."""
    rng = random.Random(6)
    base, texts = words(rng, 400, 9000), []
    for k in range(600):
        copy = list(base)
        for place in rng.sample(range(400), 4 + k % 4):
            copy[place] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    compared, counted = [], ngram_join._possible

    def possible(pairs, held):
        compared.append(pairs.count())
        return counted(pairs, held)

    monkeypatch.setattr(ngram_join, "_possible", possible)
    got = {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(sets_of(texts)).items()}
    assert len(set(got.values())) > 1
    if sum(compared) >= 600 * 600 // 2 // 4:
        pytest.xfail(f"aim not met: {sum(compared)} of 179700 pairs are compared, more than a quarter")


@pytest.mark.parametrize("rule", [ngram_join.Rule(5, 80), ngram_join.Rule(2, 55), ngram_join.Rule(1, 100)], ids=str)
def test_ngram_join_by_other_rules(spark, corpus, rule):
    """Words of an n-gram and the least similarity are parameters; groups around a base included."""
    rng = random.Random(16)
    base = words(rng, 180, 900)
    edited = []
    for k in range(60):
        copy = list(base)
        for place in rng.sample(range(180), 1 + k % 5):
            copy[place] = f"e{rng.randrange(10**6)}"
        edited.append(" ".join(copy))
    texts = [*corpus, *edited]
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + rule.words]) for k in range(max(1, len(w) - rule.words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= rule.percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    rows = ngram_join.join(frame(spark, texts), rule=rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words_, percent", [(0, 85), (4, 0), (4, 101)])
def test_rules_that_mean_nothing(words_, percent):
    with pytest.raises(ValueError, match="no rule"):
        ngram_join.Rule(words_, percent)


@pytest.mark.parametrize("percent", [50, 80, 93])
def test_linked_sets_share_signatures_by_other_rules(percent):
    rule, rng = ngram_join.Rule(5, percent), np.random.default_rng(9)
    for n in [1, 2, 4, 5, 9, 10, 21, 60, 150]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone, new = rng.integers(0, len(a) * (100 - percent) // 100 + 1, 2)
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            link = len(b) > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            assert ngram_join.linked(a, b, rule) == link
            if link:
                (sa, fa, na), (sb, fb, nb) = ngram_join.signatures(a, rule), ngram_join.signatures(b, rule)
                shared, different = len(np.intersect1d(sa, sb)), len(a) + len(b) - 2 * both
                assert shared >= max(1, (fa if len(a) <= len(b) else fb) - different, na if len(a) >= len(b) else nb)


def test_linked_sets_share_signatures():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 5, 6, 7, 8, 11, 12, 17, 30, 64, 200]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = rng.integers(0, len(a) // 6 + 1)
            more = rng.integers(0, 1 << 63, rng.integers(0, len(a) // 6 + 1), dtype=np.uint64)
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], more)))
            both = len(np.intersect1d(a, b))
            link = len(b) > 0 and 100 * both >= 85 * (len(a) + len(b) - both)
            assert ngram_join.linked(a, b) == link
            if link:
                (sa, fa, na), (sb, fb, nb) = ngram_join.signatures(a), ngram_join.signatures(b)
                shared = len(np.intersect1d(sa, sb))
                different = len(a) + len(b) - 2 * -(-85 * (len(a) + len(b)) // 185)
                assert shared >= 1 and shared >= (fa if len(a) <= len(b) else fb) - different
                assert len(sa) >= na and len(sb) >= nb


PAGES = "page_id long, url string, html string, digest string, low string, host string"


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_CHARS", 3000)
    big = "é\r\n\r\nx" * 3000
    html = [None, "", big, big, "z" * 100, "z" * 100, "z" * 99, "z" * 99, "line\r\n", "l\r\n\r", "l\r\n\r\n\r\n", "a\r\n\r\n\r\nb\r", "WARC/1.1\r\n\r\n"]
    rows = [(i, f"http://h/{i}\r\nx" if i % 3 else None, h, "d", "l", "h") for i, h in enumerate(html)]
    got = {r.page_id: tuple(r)[1:] for r in warc.archive_and_read(spark.createDataFrame(rows, PAGES)).collect()}
    first, want = {}, {}
    for i, h in enumerate(html):
        data = (h or "").encode()
        lead = first.setdefault(data, i) if len(data) >= 100 else i
        want[i] = (len(data), hashlib.sha256(data).hexdigest(), "response" if lead == i else "revisit", None if lead == i else lead)
    assert got == want
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_chunks_carry_digests(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "CHUNK_CHARS", 10)
    page = spark.createDataFrame([(7, "http://h/", "0123456789" * 3 + "end", "d", "l", "h")], PAGES)
    warc.write(page, str(tmp_path / "w"))
    chunks = warc.read_chunks(spark, str(tmp_path / "w")).orderBy("chunk").collect()
    assert [(c.chunk, c.chunk_bytes, c.bytes_so_far) for c in chunks] == [(1, 10, 10), (2, 10, 20), (3, 10, 30), (4, 3, 33)]
    assert chunks[1].digest_so_far == hashlib.sha256(b"0123456789" * 2).hexdigest()


def test_extraction(spark):
    article = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head {0}</h1><p>One &amp; {0}<br>two<p>three \n four</article><footer>foot</footer></body></html>"
    plain = "<div id=wrap><p>Repeated line</p><div><p>Own {0} text</p></div><section class='comments'>c</section><form>f</form></div>"
    rows = [(i, f"http://a.x/{i}", article.replace("{0}", str(i)), "d", "l", "h") for i in range(12)]
    rows += [(100 + i, f"http://b.x/{i}", plain.replace("{0}", f"n{i}"), "d", "l", "h") for i in range(40)]
    rows += [(200, None, None, "d", "l", "h"), (201, "", "", "d", "l", "h"), (202, "http://c.x/", "<p>a &lt;b&gt; c<script>x<p></script><!-- y --> d", "d", "l", "h")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3].text == "Head 3\nOne & 3 two\nthree four" and got[3].n_chars == len(got[3].text)
    # the style tree finds the line that all pages of the host repeat
    assert got[105].text == "Own n5 text"
    assert got[200].text == got[201].text == "" and got[202].text == "a <b> c d"
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    page = "<body><p>The same page</p><p>everywhere</p></body>"
    rows = [(i, "http://a.x/", page, "d", "l", "h") for i in range(30)]
    assert {r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"The same page\neverywhere"}


def test_copies_among_other_pages_keep_their_text(spark):
    page = "<body><article><h1>Copied</h1><p>Text</p><ul><li>One item</ul><blockquote>Quoted</blockquote></article></body>"
    other = "<body><article><h1>Head {0}</h1><p>Own {0}</p></article></body>"
    rows = [(i, f"http://a.x/{i}", page, "d", "l", "h") for i in range(50)]
    rows += [(50 + i, f"http://A.x/{i}", other.replace("{0}", str(i)), "d", "l", "h") for i in range(50)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[i] for i in range(50)} == {"Copied\nText\nOne item\nQuoted"} and got[57] == "Head 7\nOwn 7"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><p>out</p><article class='post comments-open'><p>In</p></article></body>", "In"),
        ("<p>out</p><article class='ad'><header>Head</header><p>In</p></article>", "Head\nIn"),
        ("<div id='content' class='no-sidebar'><p>Text</p></div>", "Text"),
        ("<article><p>In</p><section class='related-work'><p>Work</p></section><div class='notice'>Note</div></article>", "In\nWork\nNote"),
        ("<div class='wide sidebar'><main><p>In</p></main></div><p>out</p>", "In"),
        ("<div class='wide sidebar'><article><p>In</p></article></div>", "In"),
        ("<main><h1>Head</h1><div class='sidebar'><article><p>In</p></article></div></main>", "Head\nIn"),
        # what is named as noise beside or inside an article stays out
        ("<article><p>In</p><div class='x comments'><article>c</article></div></article><div id=related><article>r</article></div>", "In"),
        ("<article><p>In</p></article><aside><article>a</article></aside><div class='ad'>buy</div>", "In"),
        # articles that are noise by name take nothing from the rest
        ("<div><p>Text</p></div><div class='comments'><article>c</article></div>", "Text\nc"),
        ("<p>Text</p><div class='ad big'>buy</div><div role='navigation'>n</div>", "Text"),
    ],
)
def test_noise_words_spare_articles(page, text):
    assert html_extract.main_text(page, frozenset(), frozenset()) == text


def test_tree_judges_ambiguous_words(spark):
    page = "<article><h1>Head {0}</h1><p>Own {0}</p><div class='share-box'><p>Share this</p></div><div class='notice'><p>Note {0}</p></div></article>"
    rows = [(i, f"http://a.x/{i}", page.replace("{0}", str(i)), "d", "l", "h") for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[4] == "Head 4\nOwn 4\nNote 4"


def test_empty_corpus(spark):
    empty = frame(spark, [])
    assert exact_dedup.deduplicate(empty).count() == 0
    assert suffix_dedup.deduplicate(empty).count() == 0 and ngram_join.join(empty).count() == 0


def test_pipeline(spark, corpus, tmp_path):
    prose = "the river and the mill of the town in the valley is old as it was for a very long time".split()
    rng = random.Random(2)
    long = [" ".join(rng.choices(prose, k=4) + words(rng, 26, 9000) + rng.choices(prose, k=6)) for _ in range(12)]
    secret = "token = 'abcdefabcdef0123'"
    texts = [*corpus, *long, long[0], long[1] + " extra", f"{long[2]} {long[3]} {secret}"]
    docs = frame(spark, texts)
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
        tables[name] = {r.doc_id: r for r in out.collect()}
    n = len(corpus)
    kept = tables["quality_rules"]
    assert set(range(n, n + 15)) <= set(kept) and 1 not in kept
    seen, want = {}, set()
    for i in sorted(kept):
        want |= {i} if seen.setdefault(re.sub(r"\s+", " ", texts[i]), i) == i else set()
    assert set(tables["exact_dedup"]) == want
    ids = sorted(want)
    components = brute_components(sets_of([texts[i] for i in ids]))
    assert set(tables["ngram_join"]) == {i for k, i in enumerate(ids) if components[k][1] == k}
    assert set(tables["secret_scan"]) == set(tables["ngram_join"]) == set(tables["packing"])
    assert "[SECRET]" in tables["secret_scan"][n + 14].text and tables["secret_scan"][n].text == texts[n]


def test_the_near_stage_takes_five_words_and_eighty_percent(spark):
    base = words(random.Random(21), 140, 9000)
    near = [*base[:30], "one", *base[31:70], "two", *base[71:110], "three", *base[111:]]
    far = [*near[:50], "four", *near[51:]]
    grams = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in (5, 4) for w in (base, near, far)]
    share = lambda a, b: 100 * len(a & b) / len(a | b)
    assert share(grams[0], grams[1]) >= 80 > share(grams[0], grams[2]) and share(grams[3], grams[4]) < 85
    docs = frame(spark, [" ".join(base), " ".join(near)])
    assert [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()] == [0]
    docs = frame(spark, [" ".join(base), " ".join(far)])
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 1]
