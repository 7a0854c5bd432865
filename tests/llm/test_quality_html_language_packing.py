import itertools
import re
import zlib

import numpy as np
import pytest
from helpers import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F

from marketgrid.llm import html_text, language_id, packing, quality_rules

from .conftest import odd_rows


# -- quality ---------------------------------------------------------------

def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    hit = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_counts(odd, empty):
    rows = {r[0]: r[1] for r in odd_rows() if len(r[1] or "") < 6000}
    for r in quality_rules.quality(odd).collect():
        if r.doc_id in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == \
                slow_counts(rows[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality(empty).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns


def test_fences_follow_groups(spark):
    clean = " ".join(f"word{k}x" for k in range(60))
    noisy = " ".join(f"w{k}#" for k in range(60))
    rows = [(k, clean, "en", "a") for k in range(20)] + [(20, noisy, "en", "a")]
    rows += [(100 + k, noisy, "en", "b") for k in range(20)] + [(200, noisy, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.quality(df).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - {20}   # usual in b, alone in its group, odd in a
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == kept


def test_labelled_quality(spark):
    """Held against the labels of the table: no good document goes but for the
    base rule, no bad one stays."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    rows = quality_rules.quality(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_source_with_much_junk(spark):
    """Junk goes though it is a third, or half, of its source."""
    def text(k, mark):
        return " ".join(f"word{k}x{j}{mark if j % 2 else ''}" for j in range(60))
    rows, junk = [], set()
    for n, (lang, source, part) in enumerate([("en", "a", 0), ("en", "b", 3), ("en", "c", 2),
                                              ("de", "a", 0), ("de", "b", 2), (None, "a", 0)]):
        for k in range(30):
            bad = part and k % part == 0
            rows.append((100 * n + k, text(100 * n + k, "##" if bad else ""), lang, source))
            junk |= {100 * n + k} if bad else set()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == {r[0] for r in rows} - junk


def test_small_groups_follow_merged_fences(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").filter("quality = 0")
    assert quality_rules.keep_good(docs).join(labels, "doc_id", "left_semi").count() == 0


# -- pages -------------------------------------------------------------------

def test_page_rules():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p>a{}</style></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a>News</a></ul></nav>
      <div class="cookie-notice">We use cookies on this site and in the app.</div>
      <article><h1>The &amp;  title</h1><p>Short.<p>One   <b>bold</b>&nbsp;word<br>line &lt;x&gt; &#233;
      <script>var t = "</p>";</script><div class="ad">Buy this now and the other</div>
      <aside>See also the list of the others</aside><p>Last words here.</p>
      <section id="comments"><p>I was the first to comment on this and it is so good</p></section>
      </article><form><label>Name</label><input></form><footer>&copy; 2020 all of us</footer></body>"""
    assert html_text.main_text(page) == "The & title\nShort.\nOne bold word line <x> é\nLast words here."


def test_page_without_article():
    body = "It is the story of a man who went to the sea and of what he had found there. " * 4
    page = (f"<body><div class='menu'><a>A</a><a>B</a></div><h2>Heading</h2><div>{body}</div>"
            f"<p>Yes.</p><p>{body}</p><ul><li><a>one link</a></li></ul><p>© Someone</p></body>")
    text = body.strip()
    assert html_text.main_text(page) == f"Heading\n{text}\nYes.\n{text}"


def test_attributes_one_by_one():
    text = "It is the story of a man who went to the sea and of what he had found there."
    for shown in ('style="overflow:hidden"', 'aria-hidden="false"', 'title="Hidden gems"',
                  'data-id="menu-3"', "data-x='a class=\"ad\" hidden'", 'class="lead" class="ad"'):
        assert html_text.main_text(f"<article><div {shown}><p>{text}</p></div></article>") == text
        assert html_text.main_text(f"<div {shown}><article {shown}><p>{text}</p></article></div>") == text
    for unseen in ("hidden", 'hidden=""', "HIDDEN", "aria-hidden=true", "class='x ad'", "id = menu",
                   "title='a' role=\"dialog\""):
        page = f"<article><p>{text}</p><div {unseen}><p>{text} Again.</p></div></article>"
        assert html_text.main_text(page) == text


OTHER_LANGUAGES = {
    "it": "Il vecchio pescatore tornava ogni sera verso casa quando le luci del porto si accendevano, portando le "
          "reti bagnate sulle spalle e cantando piano una canzone che gli aveva insegnato suo padre molti anni prima.",
    "ru": "Старый рыбак каждый вечер возвращался домой, когда в порту зажигались огни, нёс на плечах мокрые сети и "
          "тихо напевал песню, которой много лет назад научил его отец, сидя на берегу у погасшего костра.",
    "zh": "老渔夫每天傍晚在港口的灯光亮起时回家，肩上扛着湿漉漉的渔网，轻轻哼着父亲多年前教给他的歌。海风从远处吹来，带着盐和海草的气味，"
          "村里的孩子们跟在他身后奔跑，问他今天有没有捕到大鱼。"}


@pytest.mark.parametrize("lang", sorted(OTHER_LANGUAGES))
def test_page_without_article_in_other_languages(lang):
    text = OTHER_LANGUAGES[lang]
    page = (f"<body><ul class='menu'><li><a href='/'>A</a></ul><h2>T</h2><div>{text}</div><p>{text}</p>"
            f"<div><a href='/x'>{text}</a></div><footer>{text}</footer></body>")
    assert html_text.main_text(page) == f"T\n{text}\n{text}"


def test_what_is_not_shown():
    text = "It is the story of a man who went to the sea and of what he had found there."
    for style in ("display:none", "color: red; DISPLAY : none", "visibility:hidden;", "display:none !important"):
        assert html_text.main_text(f"<article><p>{text}</p><div style='{style}'><p>{text} No.</p></div></article>") == text
    for style in ("display:none-such", "overflow:hidden", "x-display:none", "display:block"):
        assert html_text.main_text(f"<article><div style='{style}'><p>{text}</p></div></article>") == text


def test_words_of_a_class_count_whole():
    text = "It is the story of a man who went to the sea and of what he had found there."
    for name in ("article-comment-free", "legal-history", "menuetto", "read-more-share-price", "header-image"):
        assert not html_text.marks(name)
        assert html_text.main_text(f"<article><div class='{name}'><p>{text}</p></div></article>") == text
    for name in ("comment-list", "Site_Footer", "x nav-bar", "comment-12", "post-comments", "ad-slot-3", "cookie_notice"):
        assert html_text.marks(name)


def test_comments_below_a_heading():
    text = "It is the story of a man who went to the sea and of what he had found there."
    page = (f"<article><h1>A</h1><p>{text}</p><h2>Comments (3)</h2><h3>Ann</h3><ul><li>{text}<li>{text}</ul>"
            f"<h2>More</h2><p>{text}</p></article>")
    assert html_text.main_text(page) == f"A\n{text}\nMore\n{text}"
    plain = f"<div><h3>Our comments on the law</h3><p>{text}</p></div>"
    assert html_text.main_text(plain) == f"Our comments on the law\n{text}"


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (4, "u", "<p"), (5, "u", "<!-- a"),
            (6, "u", "<script>x"), (7, "u", "<article><p>" + "a b " * 50_000), (8, "u", "&am"),
            (8, "u", "&am"), (9, "u", "</p></div><article><p>x</article></article>")]
    df = spark.createDataFrame([r + ("t", 5) for r in rows],
                               "page_id bigint, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == got[2] == got[4] == got[5] == got[6] == "" and got[9] == "x"
    assert len(got[7]) == 4 * 50_000 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_of_table(spark):
    from html import unescape
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<[^>]*$", "", inner))
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in parts]
        assert r.text == "\n".join(x for x in parts if x)


# -- language -------------------------------------------------------------------

def test_gradient():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(1)
    d = language_id.Direction({k: v.astype(np.float64) for k, v in
                               language_id.Direction.fresh(rng, 3).items()})
    seq = rng.integers(97, 100, (5, 4))
    goal = rng.normal(size=(5, 4, 3))
    keep: list = []
    d.forward(seq, keep)
    grads = d.backward(seq, keep, goal.astype(np.float32))
    for name in ("x", "u", "b"):
        w = d.w[name]
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(6)] + (
                [(98, 2), (99, 7)] if name == "x" else []):
            old = w[at]
            vals = []
            for eps in (1e-3, -1e-3):
                w[at] = old + eps
                vals.append((d.forward(seq).astype(np.float64) * goal).sum())
            w[at] = old
            assert abs((vals[0] - vals[1]) / 2e-3 - grads[name][at]) < 2e-2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_odd(odd, empty):
    got = language_id.identify(odd).collect()
    assert len(got) == len(odd_rows())
    by_id = {r.doc_id: r.lang_pred for r in got}
    without = {r[0] for r in odd_rows() if not any(c.isalpha() for c in r[1] or "")}
    assert {i for i, p in by_id.items() if p == "und"} == without and by_id[12] == "en"
    assert all((r.score == r.noise == 0) == (r.doc_id in without) for r in got)
    kept = language_id.keep_known(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {
        r.doc_id for r in got if r.doc_id not in without and r.noise < language_id.NOISE}
    assert language_id.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language_id.keep_known(unlabelled).collect()} == {
        r[0] for r in odd_rows() if any(c.isalpha() for c in r[1] or "")}


def test_gibberish_goes_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rng = np.random.default_rng(3)
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "абвгдежзиклмнопрст", "αβγδεζηθικλμν")
    junk = [(10 ** 6 + k, " ".join("".join(a[i] for i in rng.integers(0, len(a), rng.integers(2, 10)))
                                   for _ in range(120))) for k, a in enumerate(alphabets * 5)]
    columns = ["doc_id", "text", "lang"]
    both = docs.select(*columns).unionByName(
        spark.createDataFrame(junk, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string")))
    kept = {r.doc_id for r in language_id.keep_known(both).collect()}
    assert not kept & {i for i, _ in junk}
    clean = [r for r in docs.collect() if r.lang and len((r.text or "").split()) >= 50]
    assert {r.lang for r in clean} == {"de", "en", "es", "fr"}
    for lang in ("de", "en", "es", "fr"):
        mine = [r.doc_id in kept for r in clean if r.lang == lang]
        assert sum(mine) >= 0.99 * len(mine)


SENTENCES = {
    "en": ["I would like to take the train to London tomorrow", "The doctor told me that I should sleep more often",
           "It was raining all day and we stayed at home", "She has never been to the mountains before"],
    "de": ["Die Kinder spielen jeden Nachmittag im Park hinter der Schule",
           "Ich möchte morgen mit dem Zug nach Hamburg fahren", "Das Wetter war gestern sehr schön und warm",
           "Wir haben lange auf den Bus gewartet"],
    "fr": ["Je voudrais prendre le train pour Paris demain matin",
           "Les enfants jouent dans le jardin derrière la maison", "Il fait très froid en hiver dans les montagnes"],
    "es": ["Los niños juegan en el parque cada tarde", "El médico me dijo que debería dormir más",
           "Hace mucho frío en las montañas durante el invierno"]}


def test_real_sentences(spark):
    """Any text with a letter gets a learned label, and everyday prose is no
    noise, whatever the invented words of the training documents."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(10 ** 7 + k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in SENTENCES.items() for t in ts)]
    odd = [(2 * 10 ** 7, "x", None), (2 * 10 ** 7 + 1, "漢字", None), (2 * 10 ** 7 + 2, "12 é", None)]
    net = language_id.train(docs)
    both = spark.createDataFrame([(i, t) for i, t, _ in rows + odd], "doc_id bigint, text string")
    got = {r.doc_id: r for r in language_id.predict(both, net).collect()}
    assert all(r.lang_pred in SENTENCES and 0 < r.score <= 1 and 0 <= r.noise <= 1 for r in got.values())
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.75 * len(rows)
    assert all(got[i].noise < language_id.NOISE for i, _, _ in rows)


def test_columns_that_clash(spark):
    """Foreign columns may have any name, those of our own working columns too."""
    from marketgrid.llm import substring_dedup
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    names = ["_kept", "_n_words", "_n_removed", "_block", "_quality_kept", "symbol_ratio_high", "_language_label",
             "lang_pred", "score", "noise", "_carried", "_scalars", "bucket", "payload", "a.b", "_lang", "_source"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for stage in (substring_dedup.remove_repeated, quality_rules.keep_good, language_id.keep_known):
        plain = {r.doc_id: r.text for r in stage(docs).collect()}
        out = stage(wide)
        assert out.columns == wide.columns
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == plain
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_rare_language_is_learned(spark):
    """Drawn from a large table, and not at the cost of the others."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang", "text")
    rare = [(10 ** 6 + k, "xx", " ".join(["kwizzok", "zokkwy", "wukkiz", "kyzzwak"] * 20)) for k in range(8)]
    both = docs.unionByName(spark.createDataFrame(rare, "doc_id bigint, lang string, text string"))
    net = language_id.train(both, n_docs=60)
    assert net.languages == ["de", "en", "es", "fr", "xx"]
    got, _, _ = language_id.Labeller(net).predict([t for _, _, t in rare])
    assert set(got) == {"xx"}
    some = [r for r in docs.collect() if r.lang and len((r.text or "").split()) >= 50]
    got, _, _ = language_id.Labeller(net).predict([r.text for r in some])
    assert sum(g == r.lang for g, r in zip(got, some)) >= 0.97 * len(some)


def test_shares():
    assert language_id.shares({}, 100) == 0
    assert language_id.shares({"a": 3, "b": 4}, 100) == 4
    assert language_id.shares({"a": 10, "b": 1000, "c": 1000}, 100, 5) == 45
    assert language_id.shares({"a": 1000, "b": 1000}, 10, 20) == 20


# -- packing ----------------------------------------------------------------------

def padding(sizes, n, bounds):
    return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, n))


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = np.unique(rng.integers(0, 60, 9))
        n = rng.integers(1, 20, len(sizes))
        for k in (1, 2, 3, 20):
            bounds = packing.choose_bounds(sizes, n, sizes * n, k)
            best = min(padding(sizes, n, [*c, sizes[-1]]) for m in range(min(k, len(sizes)))
                       for c in itertools.combinations(sizes[:-1].tolist(), m))
            assert padding(sizes, n, bounds) == best and len(bounds) <= k


def test_batches(spark, odd, empty):
    for df in (odd, spark.read.parquet(f"{SF_SMALL}/documents.parquet")):
        rows = packing.pack(df, 4, 2000).collect()
        n_words = {r.doc_id: len((r.text or "").encode().split()) for r in df.collect()}
        assert len(rows) == df.count()
        groups: dict = {}
        for r in rows:
            assert r.n_tokens == n_words[r.doc_id] <= r.bucket_len
            assert r.n_pad == r.bucket_len - r.n_tokens
            groups.setdefault((r.bucket, r.batch), []).append(r)
        for (bucket, batch), members in groups.items():
            fit = max(1, 2000 // members[0].bucket_len) if members[0].bucket_len else 10 ** 9
            assert len(members) <= fit
            last = max(b for k, b in groups if k == bucket)
            assert len(members) == fit or batch == last
    assert packing.pack(empty).count() == 0


def test_long_lengths_step_up(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(n,) for n in (0, 1, 1023, 1024, 1025, 2047, 2048, 2049, 10 ** 6)], "n long")
    got = {r.n: r.s for r in df.select("n", packing.step_length(F.col("n")).alias("s")).collect()}
    assert got[1023] == 1023 and got[1024] == 1024 and got[1025] == 1026 and got[2049] == 2052
    assert all(n <= s <= n * (1 + 1 / 512) + 1 for n, s in got.items())
