import itertools
import random
import re
from html import unescape

import numpy as np
import pytest

from heftmap.llm import htmltext as H

SMALL = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(scope="module")
def trees(spark):
    return H.fit(spark.read.parquet(SMALL))


def read(trees, html):
    page = H.Page(html)
    return H.text_of(page, H.decode(page, trees.score(H.features(page))))


def article(html):
    """The given pages' article: its headings and paragraphs."""
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))
    return "\n".join(t for t in (re.sub(r"\s+", " ", unescape(b)).strip() for b in blocks) if t)


def test_given_pages(spark, trees):
    pages = spark.read.parquet(SMALL)
    html = {r.page_id: r.html for r in pages.collect()}
    out = H.extract_text(pages, trees).collect()
    assert len(out) == len(html)
    assert all(r.text == article(html[r.page_id]) for r in out)


def test_new_layouts(spark, trees):
    """Layouts drawn with another seed, their sides taken off."""
    rng, right = random.Random(1234), 0
    pages = [r.html for r in spark.read.parquet(SMALL).limit(40).collect()]
    for html in pages:
        page = H.Page(html)
        sides = H.semantic_sides(page)
        content, other = [t for at, t in page.runs if sides[at]], [t for at, t in page.runs if sides[at] is False]
        made = H.layout(rng, content[:12], other)
        marked = H.Marked(made)
        want = "\n".join(t for at, t in marked.runs if marked.sides.get(at) == "1")
        right += read(trees, re.sub(r' data-side="."', "", made)) == want
    assert right >= 0.85 * len(pages)


def test_no_contradiction(spark, trees):
    rng = random.Random(3)
    for r in spark.read.parquet(SMALL).limit(20).collect():
        page = H.Page(r.html)
        content = H.decode(page, [rng.uniform(-4, 4) for _ in page.blocks])
        state = [H.CONTENT if c else None for c in content]
        for at in range(1, len(page.blocks)):
            up = page.blocks[at].parent
            if state[at] == H.CONTENT and page.blocks[up].own:
                assert content[up]


def test_markup():
    page = H.Page("<body><p>a &lt;b&gt; &amp;amp; &#233;<br>c\n d<p>e<script>no</script><!-- no --><b>f</b>\xa0g<style>x</style><ul><li>h<li>i</ul>tail")
    assert [t for _, t in page.runs] == ["a <b> &amp; é c d", "ef g", "h", "i", "tail"]
    assert H.Page("").runs == [] and H.Page("<<<>>> & <p").blocks


def test_odd_rows(spark, trees):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<html></html>"), (3, "w", "<article>" + "<div>" * 3000 + "<p>deep text</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = H.extract_text(pages, trees).collect()
    assert len(out) == 5 and [r.text for r in out[:4]] == [""] * 4
    assert H.extract_text(pages.where("page_id > 9"), H.fit(pages.where("page_id > 9"))).count() == 0


def test_markup_without_head_end_or_body():
    for html in ("<html><head><title>T</title><body><article><p>a</article>", "<html><head><title>T</title><meta name=x><article><p>a</article>", "<head><script>no</script><div>a</div>",
                 "<head><title>T</title>a", "<html><head><style>no</style></head><body>a", "<head><link rel=x><b>a</b>"):
        assert [t for _, t in H.Page(html).runs] == ["a"], html
    assert H.Page("<head><noscript><p>no</p></noscript><title>no</title></head>").runs == []


def test_a_block_means_the_same_among_any_number_of_siblings():
    def row(n):
        page = H.Page("<body>" + "".join(f"<p>{'long ' * 40 if i == 7 else 'short'}</p>" for i in range(n)))
        return {round(float(x), 4) for x in H.features(page)[4 + np.arange(2), 11]}

    assert row(20) == row(49) == row(50) == row(400) == {round(5 / 200, 4)}


def test_pages_without_any_landmark(spark):
    rng = random.Random(8)
    words = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(120):
        parts = [say(rng.randrange(20, 60)) for _ in range(rng.randrange(3, 8))]
        menu = "".join(f'<li><a href="/{k}">{say(2)}</a></li>' for k in range(6))
        rows.append((i, "\n".join(parts), f'<html><body><ul class="menu">{menu}</ul><div>' + "".join(f"<p>{t}</p>" for t in parts) + f'</div><div class="bottom1">{say(4)}</div></body></html>'))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(pages, H.fit(pages)).collect()}
    assert sum(want in got[i] for i, want, _ in rows) >= 0.95 * len(rows)
    assert sum(len(got[i]) <= len(want) + 60 for i, want, _ in rows) >= 0.95 * len(rows)


def test_many_copies_teach_as_one_page(spark):
    others = [r.html for r in spark.read.parquet(SMALL).limit(4).collect()]
    pages = spark.createDataFrame([(i, "u", others[0] if i >= 4 else others[i]) for i in range(3000)], "page_id bigint, url string, html string")
    found = H.fit(pages)
    assert len(found.leaf) > 0
    assert np.array_equal(found.leaf, H.fit(pages.limit(4)).leaf)
    right = sum(r.text == article(others[r.page_id]) for r in H.extract_text(pages.where("page_id < 4"), found).collect())
    assert right >= 3


def test_pages_held_out_from_the_fit(spark):
    pages = spark.read.parquet(SMALL)
    inside = "crc32(html) % 2 = 0"
    trees = H.fit(pages.where(inside))
    held = pages.where(f"NOT {inside}")
    html = {r.page_id: r.html for r in held.collect()}
    assert sum(r.text == article(html[r.page_id]) for r in H.extract_text(held, trees).collect()) >= 0.98 * len(html)


def test_decoding_is_the_best_of_all_consistent_assignments():
    rng = random.Random(4)
    below = {H.MIXED: (0, 1, 2), H.CONTENT: (1, 2), H.BOILERPLATE: (2,)}
    for _ in range(60):
        html = "<body>"
        for _ in range(rng.randrange(1, 4)):
            html += "<div>" + rng.choice(("", "own")) + "".join(f"<p>{rng.choice(('', 'x'))}</p>" for _ in range(rng.randrange(3))) + "</div>"
        page = H.Page(html)
        score = [rng.uniform(-8, 8) for _ in page.blocks]
        worth = [max(-6, min(6, s)) for s in score]

        def value(states):
            total = 0.0
            for at, (state, block) in enumerate(zip(states, page.blocks)):
                if at and state not in below[states[block.parent]]:
                    return None
                total += worth[at] if state == H.CONTENT else -worth[at] if state == H.BOILERPLATE else -(12 + abs(worth[at])) * bool(block.own)
            return total

        best = {}
        for states in itertools.product((0, 1, 2), repeat=len(page.blocks)):
            if (v := value(states)) is not None:
                chosen = tuple(s == H.CONTENT for s in states)
                best[chosen] = max(v, best.get(chosen, -1e9))
        assert best[tuple(H.decode(page, score))] == pytest.approx(max(best.values()))
