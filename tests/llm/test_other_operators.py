import hashlib
import html
import io
import re
import tarfile
import zlib

import pytest
from clicklake.llm import decontamination, html_text, licenses, media, queries, sharding, toxicity
from clicklake.llm.common import filesystem
from pyspark.sql import functions as F

from ..conftest import DATA, canonical, run_sql


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), run_sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


# Sharding

def test_shards_are_contiguous_and_near_equal(spark, documents):
    rows = sharding.shard_by_bytes(spark, documents, 7).orderBy("doc_id").collect()
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(7)]
    assert max(size) - min(size) <= 2 * max(r["size"] for r in rows)
    for s in range(7):
        assert [r["slot"] for r in rows if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows)))


def test_shards_of_odd_rows(spark, odd, empty):
    rows = sharding.shard_by_bytes(spark, odd, 3).collect()
    want = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.shard_by_bytes(spark, empty, 3).count() == 0


# Media

def brute_payload(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_media_round_trip(spark, documents):
    rows = {r["doc_id"]: r for r in media.query(spark, DATA).collect()}
    for r in documents.collect():
        p, got = brute_payload(r["text"]), rows[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (got["width"], got["height"], got["bit_depth"]) == (64, len(p) // 64, 8)
        assert got["media_sha256"] == hashlib.sha256(media.to_png(p)).hexdigest() and got["feature"] == media.feature_of(p)


def test_media_shards_are_tar_files(spark, odd, empty):
    folder, catalog = media.write_media(spark, odd)
    rows = catalog.collect()
    assert len(rows) == odd.count() and len({r["digest"] for r in rows}) == 6
    fs, base = filesystem(folder)
    for shard in {r["shard"] for r in rows}:
        with fs.open_input_file(f"{base}/{shard}") as f:
            tar = tarfile.open(fileobj=io.BytesIO(f.read()))
        for r in rows:
            if r["shard"] == shard:
                info = tar.getmember(f"{r['digest']}.png")
                assert (info.offset_data, info.size) == (r["offset"], r["length"])
                assert hashlib.sha256(media.from_png(tar.extractfile(info).read())).hexdigest() == r["digest"]
    read = media.with_features(folder, media.with_metadata(folder, media.contents(catalog)))
    assert read.count() == 6
    assert media.write_media(spark, empty)[1].count() == 0


# HTML

def test_pages_equal_a_direct_reading(spark):
    rows = {r["page_id"]: r for r in html_text.query(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert (rows[r["page_id"]]["text"], rows[r["page_id"]]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;  and\nmore", "plain <text> and more"),
        ("<p>a<p>b<br>c", "a\nb c"),
        ("<nav>x</nav><main><h1>T</h1><div>a <b>b</b></div><aside>y</aside></main><footer>z</footer>", "T\na b"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- c -->b</article>", "ab"),
        ("<article><p>a</p><div class='comments'><p>no</p></div><form>f</form></article><div>out</div>", "a"),
        ("<div class=ad>x</div><div id='cookie-notice'>y</div><p>kept</p>", "kept"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<p title='a > b'>x</p><unclosed", "x"),
        ("<div role=navigation>m</div><header>h</header>t", "t"),
    ],
)
def test_page_cases(page, want):
    assert html_text.main_text(page) == want


def test_style_tree_removes_what_a_host_repeats(spark):
    page = "<html><body><div class=bar><p>Same words on every page</p></div><div class=story><p>Story {} has its own words {}</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i, i * 7)) for i in range(12)] + [(100, "http://one.example/", page.format(1, 2)), (101, None, None), (100, "http://one.example/", page.format(1, 2))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, nodes int")
    out = html_text.extract(spark, pages).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert all(got[i] == f"Story {i} has its own words {i * 7}" for i in range(12))
    assert got[100] == "Same words on every page\nStory 1 has its own words 2" and got[101] == ""
    assert html_text.extract(spark, pages.limit(0)).count() == 0


def test_style_tree_survives_broken_markup():
    import random

    random.seed(1)
    bits = ["<div>", "</div>", "<p", ">", "a", "&", "&amp;", "<!--", "-->", "<b>", "</b>", "<li>", "</ul>", "'", '"', "<script>", "</script>", "<article>", " "]
    for _ in range(500):
        page = "".join(random.choice(bits) for _ in range(30))
        html_text.main_text(page, {html_text.path_of(0, "div"): (0.0, 0.0)})


# Licences

def test_licence_windows_meet_copies_and_near_copies(spark, odd, empty):
    mit = licenses.TEMPLATES["MIT-text"]
    words = mit.split()
    words[40] = "changed"
    cases = [(1, f"x y z {mit} a b"), (2, "Released under the MIT License."), (3, " ".join(words)), (4, " ".join(words[:30])), (5, None), (6, "released UNDER the  mit\nlicense and more")]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = {r["doc_id"]: [x["name"] for x in r["licenses"]] for r in licenses.scan_licenses(spark, df).collect()}
    assert got == {1: ["MIT-text"], 2: ["MIT"], 3: ["MIT-text"], 4: [], 5: [], 6: ["MIT"]}
    assert licenses.scan_licenses(spark, odd).filter("n_licenses > 0").count() == 0
    assert licenses.scan_licenses(spark, odd).count() == odd.count()
    assert licenses.scan_licenses(spark, empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark, df, {"short": "four words are few"})


def test_licence_versions_are_told_apart(spark):
    names = list(licenses.TEMPLATES)
    df = spark.createDataFrame([(i, f"before {licenses.TEMPLATES[n]} behind") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r["doc_id"]: [x["name"] for x in r["licenses"]] for r in licenses.scan_licenses(spark, df).collect()}
    assert {n: got[i] for i, n in enumerate(names) if got[i] != [n]} == {"Apache-2.0-header": ["Apache-2.0", "Apache-2.0-header"]}


def test_licence_near_copies_are_found_through_windows(spark):
    """Templates of whole windows with words changed, so that a containment of 0.8 to 1 is left: all have to be met."""
    import random

    draw, rows = random.Random(4), []
    for name, text in licenses.TEMPLATES.items():
        parts, own = set(licenses.shingle_texts(text)), licenses.own_shingles(licenses.TEMPLATES)[name]
        if len(licenses.shingle_texts(text)) < licenses.WINDOW + licenses.STRIDE:
            continue
        for _ in range(25):
            words = text.split()
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = f"word{draw.randrange(100)}"
            near = f"some {draw.random()} words {' '.join(words)} and more of them"
            left = set(licenses.shingle_texts(near))
            if len(parts & left) >= 0.8 * len(parts) and all(len(left & set(o)) >= 0.5 * len(o) for o in own):
                rows.append((len(rows), near, name))
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = {r["doc_id"]: [x["name"] for x in r["licenses"]] for r in licenses.scan_licenses(spark, df.select("doc_id", "text")).collect()}
    assert len(rows) > 100
    assert sum(name in got[i] for i, _, name in rows) >= 0.99 * len(rows)


def test_licences_of_a_long_text_can_be_filtered(spark):
    text = " ".join(f"w{i % 977}" for i in range(30_000)) + " " + licenses.TEMPLATES["MIT-text"]
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert [r["doc_id"] for r in licenses.scan_licenses(spark, df).filter("n_licenses > 0").collect()] == [1]


# Toxicity

def labelled(n=400):
    bad = ["idiot", "vileword"]
    out = []
    for i in range(n):
        text = f"Sentence one about thing{i % 17}. Another part number{i % 23} follows here. The end"
        if i % 4 == 0:
            text = text.replace("Another part", f"Another {bad[i // 4 % 2]}{'er' * (i % 3)} part")
        out.append((i, text, int(i % 4 == 0)))
    return out


def test_toxicity_learns_words_and_stems_and_finds_sentences(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(out[i]["predicted"] == y for i, _, y in rows)
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    for i, t, y in rows:
        assert [t[x["start"] : x["end"]].strip() for x in out[i]["offending"]] == ([t.split(".")[1].strip() + "."] if y else [])
    assert toxicity.keep_clean(docs, model).count() == sum(not y for _, _, y in rows)


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    n, right, false = scored.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("toxic")), F.count_if(F.expr("predicted = 1 and toxic = 0"))).first()
    assert right >= 0.93 * n and false <= 0.03 * n


def test_toxicity_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    toxic, caught, false = scored.agg(F.sum("toxic"), F.count_if(F.expr("predicted = 1 and toxic = 1")), F.count_if(F.expr("predicted = 1 and toxic = 0"))).first()
    assert toxic > 50 and caught >= 0.85 * toxic and false <= 0.05 * toxic


def test_toxicity_trains_on_no_more_rows_than_its_bound(spark):
    rows = labelled(40)
    docs = spark.createDataFrame([(i, f"{t} {k}") for i, t, _ in rows for k in range(30)] + [(0, rows[0][1])] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert isinstance(toxicity.train(docs, labels, train_docs=60), toxicity.Model)


def test_toxicity_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.keep_clean(odd, model).count() == odd.count()
    assert toxicity.score_documents(empty, model).count() == 0 and toxicity.keep_clean(empty, model).count() == 0


# Decontamination

def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_equals_brute_force():
    import random

    random.seed(3)
    for _ in range(200):
        a, b = [random.randrange(6) for _ in range(random.randrange(1, 20))], [random.randrange(6) for _ in range(random.randrange(0, 30))]
        assert decontamination.lcs(decontamination.bits_of(a), len(a), b) == brute_lcs(a, b)


def test_leaks_of_documents_equal_whole_passages(spark):
    """Every document that holds an item word for word is found, and no document without a long run of it."""
    docs = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    items = dict(spark.read.parquet(f"{DATA}/benchmark.parquet").collect())
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.query(spark, DATA).collect()}
    joined = {d: " ".join(decontamination.words_of(t)) for d, t in docs.items()}
    want = {(d, i) for d, t in joined.items() for i, x in items.items() if f" {' '.join(decontamination.words_of(x))} " in f" {t} "}
    assert want and want <= found
    for d, i in found - want:
        w = decontamination.words_of(items[i])
        assert brute_lcs(w, joined[d].split()) >= 0.6 * len(w)


def test_paraphrase_needs_its_answer(spark, documents):
    item = "Which mountain stands highest over the northern lowland plateau region today? The answer is mount karakoraman peak"
    words = item.split()
    filler = " ".join(f"filler{i}" for i in range(60))
    near = " ".join(w if i % 3 or i > 10 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 2 else "changed" for i, w in enumerate(words))
    mine = spark.createDataFrame([(10_001, f"{filler} {item} {filler}"), (10_002, f"{filler} {near} {filler}"), (10_003, f"{filler} {far} {filler}"), (10_004, filler), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    found = decontamination.find_leaks(spark, documents.select("doc_id", "text").unionByName(mine), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(10_001, 1), (10_002, 1), (None, 1)}


def test_leaks_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "some item text that is not there at all")], "item_id long, text string")
    assert decontamination.find_leaks(spark, odd, bench).count() == 0
    kept = decontamination.keep_unleaked(spark, odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontamination.find_leaks(spark, empty, bench).count() == 0 and decontamination.keep_unleaked(spark, empty, bench).count() == 0
    assert decontamination.find_leaks(spark, odd, bench.limit(0)).count() == 0


def test_item_in_a_third_of_all_rows_is_found(spark):
    item = "Which river carries the most water past the old harbour town in spring? It is the broad river Vellamo"
    fill = lambda i: " ".join(f"filler{i * 7 + k}" for k in range(6))
    rows = [(i, f"{fill(i)} {item} {fill(i + 1)}" if i % 3 == 0 else f"{fill(i)} {fill(i + 2)}") for i in range(900)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    want = {i for i in range(900) if i % 3 == 0}
    assert {r["doc_id"] for r in decontamination.find_leaks(spark, docs, bench).collect()} == want
    assert {r["doc_id"] for r in decontamination.keep_unleaked(spark, docs, bench).collect()} == set(range(900)) - want


def test_leaks_equal_brute_force_over_all_passages(spark):
    import random

    draw = random.Random(7)
    vocabulary = [f"w{int(draw.paretovariate(0.6)) % 3000}" for _ in range(6000)]
    words = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [words(n) for n in [15, 25, 40, 59] * 4 + [300, 400]]
    docs = []
    for i in range(120):
        own = items[i % len(items)]
        kept = [w if draw.random() >= (0, 0.15, 0.3, 0.45)[i % 4] else draw.choice(vocabulary) for w in own]
        docs.append(words(draw.randrange(0, 150)) + kept + words(draw.randrange(0, 150)) if i % 5 else words(60))
    text = lambda own: " ".join(own[:-5]) + ". " + " ".join(own[-5:])
    want = set()
    for d, doc in enumerate(docs):
        for j, own in enumerate(items):
            for p in range(decontamination.n_windows(len(doc))):
                region = doc[max(0, p * 20 - len(own)) : p * 20 + 40 + len(own)]
                if sum(w in set(own) for w in region) < 0.6 * len(own):
                    continue
                share = brute_lcs(own, region) / len(own)
                if share >= 0.7 or share >= 0.6 and brute_lcs(own[-5:], [w for w in region if w in own]) >= 4.5:
                    want.add((d, j))
                    break
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, text(w)) for j, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark, table, bench).collect()}
    assert found == want and {16, 17} <= {j for _, j in want}


def test_long_items_are_found_word_for_word(spark):
    """A window of 40 words has a cosine of some 0.2 to an item of 1,000 different words."""
    items = [" ".join(f"i{j}w{k}" for k in range(1000)) for j in range(3)]
    docs = [f"before it {items[j]} after it" for j in range(3)] + [" ".join(f"i{i % 3}w{i * 13 % 900 + k}" for k in range(100)) for i in range(30)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark, table, bench).collect()} == {(j, j) for j in range(3)}


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>a</p><h2 id='related-work'>b</h2><p id='share-prices'>c</p><div class='social-history'><p>d</p></div></article>", "a\nb\nc\nd"),
        ("<article><section id='menu-prices'><h3>x</h3></section><div id='comment-on-law'>y</div><p class='ad hoc notice'>z</p></article>", "x\ny\nz"),
        ("<article><header><h1>Title</h1><p>By A. Author</p><div class=bar>Mon 1</div></header><p>a</p></article>", "Title\na"),
        ("<header><h1>Site</h1></header><main><header>bar</header><p>a</p></main>", "a"),
        ("<article><p>a</p><div id=comments><p>c</p></div><div class='related-posts'>r</div><div class='site-ads-box'>s</div><section class='cookie-notice'>n</section></article>", "a"),
    ],
)
def test_names_of_parts_and_headers(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_long_pages_stay_small():
    """Pages of some 400 kB that close nothing, or close what is not open: memory and time in proportion."""
    import time
    import tracemalloc

    for page in ("<div class=section>" * 20_000 + "deep", "<b>x<p>" * 20_000, "<div>" * 20_000 + "</span></section>" * 20_000 + "deep", "word " * 80_000):
        tracemalloc.start()
        began = time.time()
        text = html_text.main_text(page, {1: (0.0, 0.0)})
        assert text.endswith(("deep", "x", "word")) and time.time() - began < 20
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()


def test_tree_decides_below_articles_whatever_names_say(spark):
    """What a host repeats inside its articles goes though no name tells it; a name that only holds a noise word takes nothing away."""
    page = "<article><h1>Story {0}</h1><div class=x7><p>Read all of it in our app</p></div><div class='promo-codes-explained'><p>The story {0} goes on for many words {0} and more {0} than all else on its page {0}</p></div></article>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark, pages).collect()}
    alone = {i: html_text.main_text(p) for i, _, p in rows}
    assert all("our app" not in got[i] and "our app" in alone[i] for i in got)
    assert all(f"The story {i} goes on" in got[i] for i in got)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div class='layout with-sidebar'><article><p>a</p></article><div class=sidebar>s</div></div>", "a"),
        ("<body class=x><div class='no-sidebar'><div id=social-science><main>a</main></div></div></body>", "a"),
        ("<form><div class='page has-menu'><article>a<form>f</form></article></div></form>", "a"),
        ("<div class='has-menu'><div class=menu>m</div><p>The story of the page is longer</p></div><p>end</p>", "The story of the page is longer\nend"),
        ("<nav><article>n</article></nav><div class=ad>x</div><p>kept</p>", "kept"),
        ("<article><p>The longer story</p><div class=comments><article>c</article></div></article><div class=related><article>r</article></div>", "The longer story"),
        ("<div class='social-a'><article>a</article></div><div class='social-b'><article>b</article></div>", "a\nb"),
    ],
)
def test_noise_by_name_never_holds_the_main_text(page, want):
    assert html_text.main_text(page) == want


def test_style_tree_removes_what_a_host_repeats_inside_articles(spark):
    page = "<html><body><article><h1>Story {0}</h1><p>It has its <b>own</b> words {0}</p><div>Sign up for our letters</div></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(12)] + [(100, "http://one.example/", page.format(1))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark, pages).collect()}
    assert all(got[i] == f"Story {i}\nIt has its own words {i}" for i in range(12))
    assert got[100] == "Story 1\nIt has its own words 1\nSign up for our letters"


def test_latent_space_alone_meets_paraphrases(spark, documents):
    """Of planted paraphrases with 60 % and more of an item's words in order, the cosine alone makes nearly all candidates."""
    import random

    draw = random.Random(5)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    texts = [r["text"] for r in documents.select("text").collect()]
    vocabulary = sorted({w for t in texts for w in decontamination.words_of(t)})
    rows, planted = list(enumerate(texts)), []
    for j, text in items.items():
        words = decontamination.words_of(text)
        for keep in (0.7, 0.85, 1.0):
            mine = [w if draw.random() < keep else draw.choice(vocabulary) for w in words]
            around = decontamination.words_of(draw.choice(texts))[:200]
            if brute_lcs(words, mine) >= 0.7 * len(words):
                planted.append((len(rows), j))
                rows.append((len(rows), " ".join([*around[:77], *mine, *around[77:]])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]): r["cosine"] for r in decontamination.find_leaks(spark, docs, bench).collect()}
    assert len(planted) > 100 and all(p in found for p in planted)
    assert sum(found[p] >= decontamination.COSINE for p in planted) >= 0.9 * len(planted)


def test_leaks_in_capitals_of_other_alphabets(spark):
    items = ["ΟΔΟΣ ΣΟΦΙΑΣ ΚΑΙ ΛΟΓΟΣ ΘΕΟΣ ΚΟΣΜΟΣ ΝΟΜΟΣ ΒΙΟΣ", "İZMİR İYİ BİR ŞEHİR VE İSTANBUL GİBİ DEĞİL", "what is the tallest of all the mountains here"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(10 + i, f"something before it. {x} and something after it") for i, x in enumerate(items)] + [(20, "nothing of the kind")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark, docs, benchmark).collect()} == {(10, 0), (11, 1), (12, 2)}
    assert [r["doc_id"] for r in decontamination.keep_unleaked(spark, docs, benchmark).collect()] == [20]
