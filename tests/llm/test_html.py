"""HTML extraction: plain extraction of pages whose article is marked, layouts
that training hasn't seen, tree decoding by enumeration, awkward pages."""
import difflib
import html
import itertools
import random
import re

import numpy as np
import pytest
from conftest import SF001, SF01

from quarry.llm import boosting, htmlextract as H
from quarry.llm.pagelayouts import Layouts

HAND = """<html><body><div class="topbar"><a href="/">Home</a> <a href="/n">News</a></div>
<div class="cookie-consent">We use cookies to improve your experience. <button>OK</button></div>
<div class="wrap"><div class="post"><h1>Great story &amp; more</h1>
<p>The first paragraph of the story is here, and it is long enough to be read.</p>
<div class="ad">Buy now! Cheap things for you.</div><p>Second&nbsp;paragraph with   spaces<br>and
break &lt;here&#62; <svg><text>no</text></svg> and on.</p><script>var x = "<p>no</p>";</script>
<ul><li>point one of the list<li>point two of the list</ul></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story very much, thank you.</p></div></div>
</div><form><input name=q><button>Search</button></form><footer>&copy; 2020 Site. All rights.</footer></body></html>"""
HAND_TEXT = """Great story & more
The first paragraph of the story is here, and it is long enough to be read.
Second paragraph with spaces and break <here> and on.
point one of the list
point two of the list"""


@pytest.fixture(scope="module")
def trees():
    import duckdb
    rows = duckdb.execute(f"SELECT html FROM '{SF001}/pages.parquet' ORDER BY page_id").fetchall()
    return H.fit([r[0] for r in rows])


def article(page):
    """The text of the article element, by its tags alone."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    if not found:
        return ""
    body = re.sub(r"<[^>]*\Z|</?b>", "", found[1])
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_pages_with_marked_articles(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r for r in H.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(article(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def test_hand_written_page(trees):
    assert H.extract(trees, [HAND]) == [HAND_TEXT]


def truth(page):
    """The article of a layout, without the other parts in it."""
    p = H.Pages(roles=True)
    p.add(page)
    label = np.zeros(len(p.tag), dtype=np.int64)
    for i, role in enumerate(p.roles):
        if role:
            label[i:p.last[i]] = H.IN if role == "article" else H.OUT
    return H._joined(p, label)[0]


def test_unseen_layouts(trees):
    """Layouts of another seed and other words, without their role marks."""
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9))) for _ in range(400)]
    made = Layouts(words, seed=77)
    pages = [made.page() for _ in range(150)]
    got = H.extract(trees, [re.sub(' data-role="[a-z]+"', "", x) for x in pages])
    right = total = found = 0
    for page, text in zip(pages, got):
        want = truth(page).split("\n")
        have = text.split("\n")
        same = sum(m.size for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks())
        right, total, found = right + same, total + len(want), found + len(have)
    assert right >= 0.97 * total and right >= 0.97 * found


def test_roles_are_no_features():
    assert H.attribute_bits(' data-role="article"') == 0 and H.attribute_bits(' role="main"') != 0


def test_decoding_by_enumeration():
    rnd = np.random.default_rng(0)
    for _ in range(60):
        n = int(rnd.integers(1, 8))
        parent = np.array([-1] + [int(rnd.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, dtype=np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        score = np.log(rnd.dirichlet(np.ones(3) * 0.5, n).T + 1e-9)

        def legal(x):
            for i in range(1, n):
                up = x[parent[i]]
                if (up == H.OUT and x[i] != H.OUT) or (up == H.IN and x[i] == H.THROUGH):
                    return False
            return all(any(parent[j] == i and x[j] != H.OUT for j in range(n))
                       for i in range(n) if x[i] == H.THROUGH)

        want = max(sum(score[l, i] for i, l in enumerate(x))
                   for x in itertools.product(range(3), repeat=n) if legal(x))
        got = H.decode(parent, depth, score)
        assert legal(got) and abs(sum(score[l, i] for i, l in enumerate(got)) - want) < 1e-9


def test_trees_learn_an_interaction():
    rnd = np.random.default_rng(5)
    x = rnd.random((4, 3000)).astype(np.float32)
    y = ((x[0] > 0.4) ^ (x[1] > 0.6)).astype(int) + (x[2] > 0.8)
    t = boosting.train(x[:, :2000], y[:2000], 3, rounds=20)
    assert (t.scores(x[:, 2000:]).argmax(axis=0) == y[2000:]).mean() > 0.95
    assert np.allclose(np.exp(t.scores(x)).sum(axis=0), 1)


def test_awkward_pages(spark, trees):
    words = "some words of the long article text, "
    rows = [
        (1, "u", None), (2, "u", ""), (3, None, "<html><body></body></html>"), (None, "u", HAND), (4, "u", HAND),
        (4, "u", HAND), (5, "u", "<article><p>" + words * 60_000 + "</p><p>End.</p></article>"),
        (6, "u", "<div>" * 3000 + "<article><p>" + words * 9 + "</p>"),
        (7, "u", "<article><h1>Cut</h1><p>" + words * 5 + "</p><p>More text he &amp; there</p><foot"),
        (8, "u", "<!-- <p>never ends"), (9, "u", '<p title="never ends>text'), (10, "u", "<" * 500 + "&" * 500),
        (11, "u", "<svg>" * 20_000 + "<a '" * 20_000),
    ]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows],
                               "page_id long, url string, html string, text string, n_chars long")
    got = {}
    for r in H.main_text(df.repartition(2), trees).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    assert [got[i] for i in (1, 2, 3)] == [[""]] * 3
    assert got[None] == [HAND_TEXT] and got[4] == [HAND_TEXT] * 2
    assert got[5] == [(words * 60_000).strip() + "\nEnd."]
    assert got[7] == ["Cut\n" + (words * 5).strip() + "\nMore text he & there"]
    assert got[8] == [""] and got[9] == [""]
    assert H.main_text(df.limit(0)).count() == 0


def test_markup_reading():
    p = H.Pages()
    p.add("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<b>y</p>z")
    blocks = {}
    for run, text in zip(p.run, p.text):
        blocks.setdefault(run, []).append(text)
    assert ["".join(x) for x in blocks.values()] == ["a", "b", "c", "d", "1", "2", "3", "xy", "z"]
    li = [i for i, t in enumerate(p.tag) if t == H.GROUP_OF["li"]]
    assert [p.depth[i] for i in li] == [2, 2, 4, 2]
