"""HTML extraction, toxicity and its automaton."""

import random
import re
import zlib

import numpy as np
import pytest

from floodlens.llm import html_text, toxicity
from floodlens.llm.automaton import TermAutomaton, tolerance
from floodlens.llm.html_blocks import blocks

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Logo</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>Accept</button></div><div class="ad">Buy this now.</div>
<article><h1>The  head&shy;line</h1><p>First &amp; <b>bold</b> text&nbsp;here,\n with more<br>words to read. It goes on for a while.<p>Second paragraph is unclosed, and long enough to read.
<ul><li>A point made in the list of the article.</li></ul></article><aside class="sidebar"><p>Related: other</p></aside>
<section id="comments"><h3>Comments</h3><p class="comment">I do not agree with this at all, it is wrong.</p></section>
<form><input name="q"><label>Search</label></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.trained().main_text(PAGE).split("\n\n") == [
        "The head\xadline", "First & bold text here, with more words to read. It goes on for a while.", "Second paragraph is unclosed, and long enough to read.",
        "A point made in the list of the article."]


def test_held_out_labelled_pages():
    model, right, total = html_text.trained(), 0, 0
    for page, labels in html_text.labelled_pages(200, seed=7):
        found = list(blocks(page))
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(model.decode(found), labels))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_equals_brute_force():
    from itertools import product

    rng, model = random.Random(2), html_text.trained()
    for page, _ in html_text.labelled_pages(30, seed=9):
        found = list(blocks(page))[:9]
        emit = [sum(model.weights.get(f, 0) for f in fs) for fs in html_text.features(found)]

        def score(labels):
            s = model.first[labels[0]] + sum(e for e, y in zip(emit, labels) if y)
            return s + sum(model.pairs[a][b] for a, b in zip(labels, labels[1:]))

        best = max(product((0, 1), repeat=len(found)), key=score)
        assert score([int(x) for x in model.decode(found)]) == pytest.approx(score(best))
    assert rng


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></div>", "<!-- never closed", "<script>never closed", "&", "&#0;", "<b><i></b></i>", "\x00", "<" * 2000, "<div>" * 3000])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.trained().main_text(page), str)


def test_page_table(spark):
    long = "<article>" + "<p>" + "many words go here and on. " * 20_000 + "</p></article>"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "", "", "y"), (4, "v", long, "z")]
    out = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    have = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(have) == 5
    assert all(r.n_chars == len(r.text) for r in have)
    assert {r.page_id: r.n_chars for r in have}[4] == len("many words go here and on. " * 20_000) - 1
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def distance(a, b):
    """Letters put in, left out or replaced, or neighbours swapped."""
    rows = [[max(i, j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2:i] == b[j - 2:j][::-1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(60)}
    automaton = TermAutomaton(terms, ["abcabc"])
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        near = sorted((distance(word, t), t) for t in terms if distance(word, t) <= tolerance(t))
        want = near[0][::-1] if near else None
        if word.startswith("abcabc") and (want is None or want[1] > 0):
            want = ("abcabc*", 0)
        assert automaton.find(word) == want


def corpus(n=1200, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdegiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["vilerson", "grubhead", "nastyface", "dimmling"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = int(i % 7 == 0)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) if rng.random() < 0.8 else rng.choice(["vilersom", "grubhaed" [:7], "nastyfase"]))
        elif i % 11 == 0:
            words.insert(rng.randrange(len(words)), f'he said "{rng.choice(bad)}" and was wrong')
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    automaton = model.automaton()  # each is a term or begins with a stem
    assert all(automaton.find(w) for w in ("vilerson", "grubhead", "nastyface", "dimmling"))
    truth = {i: y for i, _, y in rows}
    scored = toxicity.score(docs, model).collect()
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r.held_out]
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert right > 0.97
    fresh = spark.createDataFrame(
        [(1, "you nastyfacz go home"), (2, 'they wrote "nastyface" on it'), (3, None), (4, ""), (5, "plain " * 60_000 + "grubhead"), (None, "x"), (1, "you nastyfacz go home")],
        "doc_id long, text string")
    have = {(r.doc_id, r.predicted): r.score for r in toxicity.score(fresh, model).collect()}
    assert (1, 1) in have and (2, 0) in have and (3, 0) in have and (4, 0) in have and (5, 1) in have and (None, 0) in have
    assert all(0 <= s <= 1 for s in have.values())
    kept = toxicity.drop_toxic(fresh.selectExpr("doc_id", "'a' as score", "text", "'b' as predicted"), model)
    assert kept.columns == ["doc_id", "score", "text", "predicted"] and {r.doc_id for r in kept.collect()} == {2, 3, 4, None}


@pytest.mark.parametrize("labels,want", [([], 0), ([(1, 0), (2, None)], 0), ([(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (7, 1)], 1)])
def test_toxicity_without_both_kinds(spark, labels, want):
    docs = spark.createDataFrame([(i, "some text") for i in range(8)], "doc_id long, text string")
    scored = toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len(scored) == 8 and {r.predicted for r in scored} == {want}


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = (toxicity.learn(docs, x) for x in (labels, turned))
    assert a.weights == b.weights and a.bias == b.bias and (a.beta == b.beta).all()
    assert toxicity.score(docs.limit(0), a).count() == 0


PROSE = ["Some ordinary prose that goes on for a while, with a comma and a full stop.", "Another sentence of the article which a reader would want to read in full."]
NOISE = "Text that is not wanted at all, although it is a long sentence with words."
STORY = f"<h1>Head line here</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p>"


@pytest.mark.parametrize("body", [
    *(f"<article>{STORY}<div class='{c}'><p>{NOISE}</p></div></article>" for c in ("comments", "reader-comments", "replies", "related-posts", "ad", "share-buttons")),
    *(f"<article><h1>Head line here</h1><p>{PROSE[0]}</p><div class='{c}'>{NOISE}</div><p>{PROSE[1]}</p></article>" for c in ("ad", "advert", "sponsored", "promo")),
    *(f"<div class='{c}'><p>{NOISE}</p></div><article>{STORY}</article>" for c in ("cookie-notice", "alert", "newsletter", "menu", "sidebar")),
    *(f"<div id='content'>{STORY}</div><{t}><p>{NOISE}</p></{t}>" for t in ("aside", "footer", "form", "nav")),
    f"<div class='container'><div class='row'><div class='col main-content'>{STORY}</div><div class='col sidebar'><p>{NOISE}</p></div></div></div>",
    f"<div role='navigation'><a href=a>Home</a></div><div role='main'>{STORY}</div><div role='contentinfo'>{NOISE}</div>",
    f"<header><h1>Site name</h1><p>Tag line</p></header><article><header><h1>Head line here</h1></header><p>{PROSE[0]}</p><p>{PROSE[1]}</p></article>",
])
def test_layouts(body):
    assert html_text.trained().main_text(f"<html><head><title>T</title></head><body>{body}</body></html>").split("\n\n") == ["Head line here", *PROSE]


def learn_from(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def test_misspellings_seen_once_or_twice_still_count(spark):
    rows = corpus()
    toxic = [k for k, (i, _, y) in enumerate(rows) if y and zlib.crc32(str(i).encode()) % 5]
    for k in toxic[:2]:
        rows[k] = (rows[k][0], rows[k][1] + " qastyface", 1)
    model = learn_from(spark, rows)
    matcher = toxicity.Matcher(model)
    assert matcher.value("qastyface") == matcher.value("xastyface") == model.weights["nastyface"] > 0


def test_words_of_a_stem_stay_terms(spark):
    rng, rows = random.Random(5), corpus(4000)
    model = learn_from(spark, rows)
    assert {"vilerson", "grubhead", "nastyface", "dimmling"} <= set(model.weights)
    fresh = spark.createDataFrame([(1, "you vilerzon go home"), (2, 'they wrote "vilerson" on it')], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(fresh, model).collect()} == {1: 1, 2: 0}
    family = ["vilerson" + end for end in ("ed", "ing", "ly", "ous", "ful", "ist", "dom")]
    rows = [(i, " ".join(rng.choice(family) if w in ("vilerson", "vilersom", "grubhead", "grubhae", "nastyface", "nastyfase", "dimmling") else w for w in t.split()), y) for i, t, y in rows]
    model = learn_from(spark, rows)
    assert set(family) <= set(model.weights) and toxicity.Matcher(model).value("vylersoning") is not None


def test_terms_of_set_phrases_are_learnt_and_words_of_copies_are_not(spark):
    rows, extra = corpus(2000), random.Random(9)
    own = [" ".join("".join(extra.choice("cfhjqvwxyz") for _ in range(7)) for _ in range(120))]
    toxic = [k for k, (i, _, y) in enumerate(rows) if y and zlib.crc32(str(i).encode()) % 5]
    for n, k in enumerate(toxic):
        if n % 4 == 0:
            rows[k] = (rows[k][0], rows[k][1] + " you zorkwit", 1)
        elif n % 4 == 1:
            words = own[0].split()
            words[n % 120] = f"other{n}"
            rows[k] = (rows[k][0], " ".join(words), 1)
    model = learn_from(spark, rows)
    assert "zorkwit" in model.weights
    assert not set(own[0].split()) & set(model.weights)


INSULTS = ["trash", "worthless", "pathetic", "disgusting", "idiot", "loser", "moron", "clown", "stupid"]


def misspelt(word, how):
    k = len(word) // 2
    return word[:k] + "x" + word[k + 1:] if how == "replaced" else word[:k - 1] + word[k] + word[k - 1] + word[k + 1:]


def test_misspelt_insults_of_the_given_documents_are_caught(spark):
    """One inner letter replaced or two swapped in every insult of the held-out documents that are caught as they are written."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    assert set(INSULTS) <= set(model.weights)
    rows = docs.join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out()).select("doc_id", "text", "toxic").collect()
    matcher = toxicity.Matcher(model)
    caught = lambda text: model.probability(np.array([matcher.features(text)]))[0] >= 0.5
    pattern = re.compile("|".join(INSULTS), re.I)
    toxic = [r.text for r in rows if r.toxic and caught(r.text) and not caught(pattern.sub("", r.text))]
    assert len(toxic) >= 20
    for how in ("replaced", "swapped"):
        changed = [pattern.sub(lambda m: misspelt(m.group().lower(), how), t) for t in toxic]
        assert sum(map(caught, changed)) >= 0.9 * len(toxic)
    clean = [r.text for r in rows if not r.toxic]
    assert sum(map(caught, clean)) < 0.01 * len(clean)
    right = sum(caught(r.text) == (r.toxic > 0) for r in rows)
    assert right > 0.98 * len(rows)
    # The same words in quotation count for less.
    for word in INSULTS:
        said, meant = f'he wrote "{word}" and "{word}" on the wall', f"he is a {word} and {word} like you all"
        assert model.probability(np.array([matcher.features(said)]))[0] < model.probability(np.array([matcher.features(meant)]))[0]


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 5, f"text number {i}") for i in range(400)] + [(1, "text number 1")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, 30)
    assert sample.count() == sample.select("doc_id", "text").distinct().count() == 30
    assert set(toxicity._sample(docs, labels, 1_000).columns) == {"doc_id", "text_key", "text", "toxic"}


WANT = ["Head line here", *PROSE]
#: Beginnings and ends of pages that browsers forgive; none hides the article or shows anything else.
BEGINS = ["<html><head><title>T</title></head><body>", "<html><head><title>T</title><body>", "<head><title>T</title><meta name=x>", "<title>T</title>",
          "<html><head><title>T</title><body class=it's>"]
SHAPES = ["<object data=a>", "<div title=it's>", "<svg><path d='m'>", "<video src=a>", "<select><option>one<option>two", "<button>press", "<canvas id=c>", "<math>",
          "<audio controls>", '<a href=x"y></a>', "<template>", ""]


@pytest.mark.parametrize("shape", SHAPES)
def test_articles_behind_tags_left_open(shape):
    for begin in BEGINS:
        for comments in ("", f'<ol class="commentlist"><li>{NOISE}</li><li><p>{NOISE}</p></ol>', f"<ul id=commentsArea><li>{NOISE}<li>{NOISE}</ul>"):
            for page in (f"{begin}{shape}<article>{STORY}{comments}</article>", f"{begin}{shape}<main>{STORY}</main>{comments}</body></html>"):
                assert html_text.trained().main_text(page).split("\n\n") == WANT, page


def test_silent_elements_that_are_closed_stay_silent():
    page = f"<body><template><article>{STORY}</article></template><object><p>{NOISE}</p></object><button><div>press</div></button><select><option>a</select><article>{STORY}</article>"
    assert html_text.trained().main_text(page).split("\n\n") == WANT


def test_held_out_layouts():
    right = total = 0
    for page, labels in html_text.labelled_pages(300, seed=7):
        found = list(blocks(page))
        assert len(found) == len(labels)
        decoded = html_text.trained().decode(found)
        right, total = right + sum(a == b for a, b in zip(decoded, labels)), total + len(labels)
    assert right >= 0.995 * total


def test_names_written_as_one():
    names = next(blocks('<div class="commentlist sidebarLeft relatedposts"><p>x</p></div>')).names
    assert {"comment", "commentlist", "sidebar", "related"} <= names
