"""What elements and their attributes say of the blocks in them."""

import numpy as np
import pytest

from statloom.llm import op3_html


@pytest.mark.parametrize("said", ['href="/hidden-gems"', 'title="the hidden truth"', "alt='so, hidden'", 'data-hidden="false"', 'data-role="comment"', "href=/hidden", 'title="no end, hidden'])
def test_other_attributes_say_nothing(said):
    assert op3_html.tag_flags("div", " " + said) == 0


@pytest.mark.parametrize("said", ["hidden", "HIDDEN", 'style="display: none"', 'aria-hidden="true"', "id=x hidden"])
def test_hidden(said):
    assert op3_html.tag_flags("div", " " + said) & op3_html.DROP


def test_main_and_boiler_words_stand_side_by_side():
    assert op3_html.tag_flags("div", ' class="post share"') == op3_html.MAIN | op3_html.BOILER


def boiler(page):
    texts, rows = op3_html.blocks(page)
    return dict(zip(texts, rows[:, op3_html.FEATURES.index("boiler")].astype(bool).tolist()))


def test_implied_ends():
    assert boiler("<div><p class=share>a<p>b<div>c</div></div>") == {"a": True, "b": False, "c": False}
    assert boiler("<ul><li class=ad>a<li>b<ul><li>c</ul><li class=ad>d<ul><li>e</ul></ul>") == {"a": True, "b": False, "c": False, "d": True, "e": True}
    assert boiler("<dl><dt class=ad>a<dd>b<dt>c</dl>") == {"a": True, "b": False, "c": False}
    assert boiler("<p class=share>a<table><tr><td><p>b</table>") == {"a": True, "b": False}
    assert op3_html.blocks("<div><option>a<option>b</option>c</div>")[0] == ["c"]


def test_the_tree_of_the_given_pages(spark):
    """Trained on a sample of pages: the text is what names say, found by words and link densities first; without any name
    nearly all blocks are still told, and not without words or densities."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tree = op3_html.train(spark, pages)
    assert op3_html.FEATURES[tree["feature"][0]].startswith(("link_density", "words"))
    features = np.concatenate([op3_html.blocks(r.html or "")[1] for r in pages.collect()])

    def told(*zero):
        rows = features.copy()
        rows[:, [k for k, x in enumerate(op3_html.FEATURES) for z in zero if (k in op3_html.NAMED if z == "names" else x.startswith(z))]] = 0
        return op3_html.predict(tree, rows) > 0.5

    names = op3_html.said_by_names(features)
    assert np.mean(told() == names) >= 0.999
    assert np.mean(told("names") == names) >= 0.97
    assert np.mean(told("words") != told()) > 0.1
    assert np.mean(told("names", "link_density") != told("names")) > 0.01


def test_pages_without_names(spark):
    tree = op3_html.train(spark)
    assert op3_html.main_text("<p>just text here</p>", tree) == "just text here"
    assert op3_html.main_text("<div>one two three</div><p>four five six</p>", tree) == "one two three\nfour five six"
    assert op3_html.main_text("<ul><li><a href=/a>x</a><li><a href=/b>y</a></ul>", tree) == ""
    assert op3_html.main_text('<div class="cookie-notice">we use cookies</div>', tree) == ""
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "<p>x"), (1, None)], "page_id long, html string")
    assert sorted(r.text for r in op3_html.extracted(odd).collect()) == ["", "", "", "x"]
