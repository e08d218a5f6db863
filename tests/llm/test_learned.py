"""Toxicity, co-training and HTML extraction: plain versions, held-out accuracy, odd rows."""

import html
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm.cotraining import META_DIMS, meta_view, score_quality
from cuewright.llm.html_blocks import blocks_of
from cuewright.llm.html_extract import HIDDEN, Labeller, _extract, block_vectors, extract_text, made_page, train
from cuewright.llm.queries import op4_toxicity, op8_cotraining, op10_html_extraction
from cuewright.llm.toxicity import BACKGROUND, STRENGTHS, Lexicon, _lgamma, decay, fit_prior, score_toxicity, segments, shrunk

SF = "/root/testdata/sf0.01"


def plain_segments(scores):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    left = plain_segments(scores[: at[0]])
    right = plain_segments(scores[at[1] :])
    return [*left, (*at, best), *((a + at[1], b + at[1], s) for a, b, s in right)]


@given(st.lists(st.sampled_from([BACKGROUND, BACKGROUND, 0.7, 1.1, 2.3, 0.25]), max_size=24))
@settings(max_examples=300, deadline=None)
def test_segments(scores):
    got = segments([(i, s) for i, s in enumerate(scores) if s > 0])
    want = plain_segments(scores)
    assert abs(sum(s for _, _, s in got) - sum(s for _, _, s in want)) < 1e-6 or [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(s - sum(scores[a:b])) < 1e-6 for a, b, s in got)
    assert max((s for _, _, s in got), default=0) == max((s for _, _, s in want), default=0) or abs(max(s for _, _, s in got) - max(s for _, _, s in want)) < 1e-6


def test_decay_is_the_root():
    bins = [(-0.3, 0.99), (5.0, 0.01)]
    x = decay(bins)
    assert abs(sum(p * np.exp(x * s) for s, p in bins) - 1) < 1e-6 and x > 0


def test_toxicity_held_out(spark):
    got = op4_toxicity(spark, SF).toPandas()
    said = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    both = got.merge(said, on="doc_id")
    clean = both[(both.toxic == 0)]
    assert (clean.predicted == 0).mean() > 0.95


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_held_out_recall(spark, sf):
    said = pd.read_parquet(f"/root/testdata/{sf}/labels.parquet")
    both = op4_toxicity(spark, f"/root/testdata/{sf}").toPandas().merge(said, on="doc_id")
    held = both[both.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.94
    assert held[held.toxic == 0].predicted.mean() <= 0.02


def test_toxicity_scores_every_word():
    names, yt, yn = ["=rare", "=calm", "=both"], np.array([2, 0, 9]), np.array([0, 40, 91])
    hashes = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in names], np.uint64).view(np.int64)
    prior = fit_prior(yt.astype(float), yn.astype(float), np.ones(3), 1 / 11)
    lexicon = Lexicon(hashes, yt, yn, 1 / 11, prior)
    got = dict(lexicon.learn({"rare", "calm", "both"}))
    assert got["rare"] > 0 and got["calm"] < got["both"] < 0 and BACKGROUND not in got.values()
    fewer = Lexicon(hashes, yt - [1, 0, 1], yn, 1 / 11, prior).learn({"rare", "calm", "both"})
    out = lexicon.without({"rare", "both"}, 1)  # a toxic text is scored as if it had not been counted
    assert all(abs(out[w] - fewer[w]) < 1e-12 for w in out)


def test_prior_follows_the_counts():
    """Counts that all follow the shares need a strong prior, counts that take sides a weak one; the mixture has both."""
    rng = np.random.default_rng(3)
    plain = rng.binomial(100, 0.1, 2000)
    sided = np.where(rng.random(200) < 0.5, 95, 1)
    yt, n = np.concatenate([plain, sided]).astype(float), 100.0
    prior = fit_prior(yt, n - yt, np.ones(len(yt)), 0.1)
    assert abs(prior.sum() - 1) < 1e-9 and 0.05 < prior[STRENGTHS < 16].sum() < 0.15 and prior[STRENGTHS > 256].sum() > 0.8
    delta, _ = shrunk(np.array([0, 10.0, 95]), np.array([0, 90.0, 5]), 0.1, prior)
    assert abs(delta[0]) < 0.6 and abs(delta[1]) < 0.05 and delta[2] > 4
    assert np.allclose(_lgamma(np.array([0.05, 1, 7.5, 4000])), [math.lgamma(x) for x in (0.05, 1, 7.5, 4000)])


def test_toxicity_catches_planted_words(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows, said = [], []
    for i in range(1200):
        body = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 10 == 0
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(("scoundrel", "nitwit", "Blockheadish" + rng.choice(("a", "en", "ung"))))
        rows.append((i, " ".join(body)))
        said.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(said, "doc_id long, toxic int")
    got = score_toxicity(docs, labels).toPandas().merge(pd.DataFrame(said, columns=["doc_id", "toxic"]), on="doc_id")
    held = got[got.held_out]
    assert (held[held.toxic == 1].predicted == 1).all() and (held[held.toxic == 0].predicted == 0).mean() > 0.98


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    assert score_toxicity(odd_docs, labels).count() == odd_docs.count()
    assert score_toxicity(odd_docs, labels.limit(0)).filter("score = 0").count() == odd_docs.count()
    assert score_toxicity(no_docs, labels).count() == 0


def test_quality_held_out(spark):
    got = op8_cotraining(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.kept == (held.quality == 1)).mean() > 0.95
    assert (held[held.quality == 1].kept).mean() > 0.97


def test_capitals_count_alike_at_every_length():
    at = META_DIMS - 9  # the share of capitals
    for unit, share in (("É", 0.0), ("AÉ", 0.5), ("Ab", 0.5)):
        for times in (10, 200, 255, 256, 257, 5000):
            text = unit * times
            assert abs(meta_view(text, None, None)[at] - share * len(text) / (len(text) + 1)) < 1e-6


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert score_quality(odd_docs, labels).count() == odd_docs.count()
    assert score_quality(odd_docs, labels.limit(0)).filter("kept").count() == odd_docs.count()
    assert score_quality(no_docs, labels).count() == 0


def test_html_query_gives_the_articles(spark):
    got = {r.page_id: r for r in op10_html_extraction(spark, SF).collect()}
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    for i, page in zip(pages.page_id, pages.html):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?p>|</?h1>", inner))
        assert got[i].text == "\n".join(p for p in parts if p)
        assert got[i].n_chars == len(got[i].text)


@pytest.fixture(scope="module")
def model():
    return train([])


def test_html_other_layouts(model):
    rng = random.Random(77)
    right = total = 0
    for _ in range(150):
        page, labels = made_page(rng, "river hill stone cloud meadow lantern harbour".split())
        blocks = blocks_of(page)
        assert len(blocks) == len(labels)
        chosen = model.label([block_vectors(blocks)])[0] >= 0.5
        right += int((chosen == np.array(labels, bool)).sum())
        total += len(labels)
    assert right / total > 0.99


def test_network_gradients():
    rng = np.random.default_rng(0)
    model = Labeller()
    model.p = [p.astype(np.float64) for p in model.p]
    from cuewright.llm.html_extract import DIMS

    x = rng.standard_normal((2, 4, DIMS)) * 0.1
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y, w = rng.integers(0, 2, (2, 4)).astype(float), mask.astype(float)
    _, grads = model.gradients(x, mask, y, w)
    for k in range(len(model.p)):
        at = tuple(rng.integers(0, s) for s in model.p[k].shape)
        keep = model.p[k][at]
        values = []
        for d in (1e-3, -1e-3):
            model.p[k][at] = keep + d
            values.append(model.gradients(x, mask, y, w)[0])
        model.p[k][at] = keep
        assert abs((values[0] - values[1]) / 2e-3 - grads[k][at]) < 1e-4
    assert HIDDEN * 4 == model.p[2].shape[0]


def test_blocks():
    page = "<!doctype html><title>t</title><body><p>a &amp;amp; b<br>c &lt;i&gt;<p>d <b>e\n\n f</b>g<!-- no --><script>if(a<b)'</p>'</script><div class='x \"y' >h<li>i<li>j</ul></div>k <"
    got = blocks_of(page)
    assert [b.text for b in got] == ["a &amp; b c <i>", "d e fg", "h", "i", "j", "k <"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p></p>") == []
    assert blocks_of("plain text")[0].text == "plain text"


@pytest.mark.parametrize(
    "tag, inside",
    [
        ('<svg class="i"/>', ""), ("<svg/>", ""), ("<math/>", ""), ('<svg-icon name="a"></svg-icon>', ""), ("<math-field></math-field>", ""),
        ("<title-bar></title-bar>", ""), ("<object-card></object-card>", ""), ('<script-box class="x">', ""), ("<style-guide/>", ""),
        ("<svg><title/><style/><path d='M0 0'/></svg>", ""), ("<svg><title>icon</title><g><path d='M0 0'/></g></svg>", ""),
        ("<script>if(a<b)'</p>'</script >", ""), ("<style>p{}</style x>", ""), ("<template><p>no</p></template>", ""),
        ("<math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup></math>", "x=2n"), ("<svg><text>left</text><text>right</text></svg>", "left right"),
        ("<noscript>still text</noscript>", "still text"), ("<object data='a'>fallback words</object>", "fallback words"), ("<iframe src='a'/>", ""),
    ],
)
def test_blocks_keep_the_text_behind_odd_elements(tag, inside):
    got = blocks_of(f"<body><article><p>one two {tag}</p><p>three four</p></article><p>five</p></body>")
    assert " ".join(b.text for b in got).split() == f"one two {inside} three four five".split()
    assert [b.tags for b in got if b.text == "three four"] == [["body", "article", "p"]] or "-" in tag


def test_formulas_stay_in_their_line():
    got = blocks_of("<p>so <math><mi>x</mi><mo>&gt;</mo><mn>0</mn></math> holds <svg><path d='M0'/></svg> here</p>")
    assert [b.text for b in got] == ["so x>0 holds here"]


def test_blocks_see_all_names_and_links():
    """A telling class behind any number of others, links at any depth, links that end where the next begins."""
    many = " ".join(f"u{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    assert "sidebar" in blocks_of(f'<div class="{many} sidebar">text</div>')[0].path[0]
    deep = blocks_of("<a href='x'><b><i><u><em><strong>all of it</strong></em></u></i></b></a>")
    assert [b.links for b in deep] == [1.0]
    after = blocks_of("<p><a href='x'>one<a href='y'>two</a> rest</p><p>plain</p>")
    assert [b.links for b in after] == [6 / len("onetwo rest"), 0.0]


def test_html_keeps_articles_with_odd_elements(model):
    say = "The river runs past the old harbour and the people of the town walk along it in the evening, {}."
    odd = ['<svg class="i"/>', "<svg-icon></svg-icon>", "<math-field></math-field>", "<title-bar></title-bar>", "<object-card></object-card>", "<math><mi>x</mi></math>"]
    for tag in odd:
        page = f"<html><body><article>{tag}" + "".join(f"<p>{say.format(i)}</p>" for i in range(6)) + "</article></body></html>"
        text = _extract([[page]], model)[0][0]
        assert all(say.format(i) in text for i in range(6)), tag


def test_html_odd_rows(spark, model):
    pages = [None, "<article><p>Some text of an article.</p></article>", "", "<" * 50_000, "<div>" * 20_000 + "x"]
    texts, lengths, _ = _extract([pages], model)
    assert len(texts) == 5 and texts[0] == texts[2] == "" and lengths == [len(t) for t in texts]
    assert texts[1] == "Some text of an article."
    rows = [(None if i == 1 else i, None, p, 1) for i, p in enumerate(pages)]
    assert extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").limit(0)).count() == 0
