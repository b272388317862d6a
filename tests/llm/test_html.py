import re
import time
from html import unescape

import numpy as np
import pytest

from kinmatch.llm import op10_html as o

W = "word " * 30
PAGES = {
    "": "", "just text": "", "<p>": "",
    "<article><h1>T</h1><p>A &lt;b&gt; &amp; c&nbsp;d</p><p>x</p></article><footer>f</footer>": "T\nA <b> & c d\nx",
    "<body><header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>one<br>two</p><aside>see</aside><div class='cookie-notice'>we</div>"
    "<section id='comments'><p>c</p></section><form><label>Mail</label></form><p>end</p></article></main>": "T\none two\nend",
    "<nav><a href=x>Home</a></nav><article><p>a<b>b</b>c <i>d</i>\n\n e</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>q</article>": "abc d e\nq",
    "<article><p>unclosed <p>second<p>third <b>bold": "unclosed\nsecond\nthird bold",
    "<div class=ad>" + W + "</div><article><p>5 < 6 &#233;&eacute;</p></article>": "5 < 6 éé",
    "<div><a href=a>Home</a> <a href=b>News</a></div><h2>Head</h2><p>" + W + "</p><p>Short.</p><p>" + W + "</p><div class='comment-list'><p>" + W + "</p></div><div>(c) 2020</div>":
        "Head\n" + W.strip() + "\nShort.\n" + W.strip(),
    "<ul><li><a>a</a><li><a>b</a></ul><div id=sidebar>" + W + "</div>": "",
    "<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>": "one\ntwo\nx\ny",
}


@pytest.mark.parametrize("html", PAGES)
def test_pages(html):
    assert o.main_text(html) == PAGES[html]


def test_tables_articles(spark, sf):
    """The pages at hand have one article each; what is in its blocks, and nothing else, comes out."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    made = {r["page_id"]: r for r in o.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        want = [" ".join(unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert made[r["page_id"]]["text"] == "\n".join(w for w in want if w)
        assert made[r["page_id"]]["n_chars"] == len(made[r["page_id"]]["text"]) and made[r["page_id"]]["url"] == r["url"]


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article>a</article>", "y"), (2, "v", "<p>" * 50000 + "<" * 1000 + "&amp" * 999, "z")]
    got = o.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r["page_id"] or -1, r["text"][:9]) for r in got.collect())[:3] == [(-1, "a"), (1, ""), (1, "")]
    assert got.where("false").count() == 0


DEPARTURES = {
    f"<form id=aspnetForm><article><h1>T</h1><p>{W}</p><form class=search><p>q</p></form></article><div class=footer>{W}</div></form>": "T\n" + W.strip(),
    f"<body><form method=post id=form1><div id=head><a href=a>Home</a></div><h1>Head</h1><p>{W}</p><p>{W}</p><p>Fin.</p><div class=sidebar>{W}</div></form></body>": f"Head\n{W.strip()}\n{W.strip()}\nFin.",
    f"<article><p>{W}</p></article><form><p>{W}</p><p>{W}</p></form>": W.strip(),
    f'<article><h1>T</h1><section class="related-work"><h2>Related work</h2><p>{W}</p></section><section id="search-algorithms"><p>{W}</p></section></article>': f"T\nRelated work\n{W.strip()}\n{W.strip()}",
    f'<article><p>one <span class="ad-word">two</span> three</p><div class="related-posts"><p>{W}</p></div><div class="comment-form-3"><p>{W}</p></div></article>': "one two three",
    f'<aside><article class="card"><p>{W}</p></article></aside><article><p>{W}end</p></article>': W + "end",
    f'<article><header class="entry-header"><h1>T</h1></header><p>{W}</p></article>': "T\n" + W.strip(),
    f'<article><h1>T</h1><p>{W}</p><p class="advert">{W}</p><p class="notice">Mind this.</p><p>end</p></article>': f"T\n{W.strip()}\nend",
    "<article><p>a <span hidden>b</span><span class='ad-label'>ad</span> c</p><p>d <i hidden>e <p>f</p></article>": "a c\nd\nf",
    f"<div><a href=a>Home</a></div><h1>Head</h1><p>{W}</p><p>{W}</p><p>Fin.</p>": f"Head\n{W.strip()}\n{W.strip()}\nFin.",
    f'<article><section class="summary-content-alert"><p>{W}</p></section></article>': W.strip(),
    f"<article><p>{W}</p><div class='post-comments'><p>{W}</p></div></article>": W.strip(),
}


@pytest.mark.parametrize("html", DEPARTURES)
def test_parts_of_articles(html):
    assert o.main_text(html) == DEPARTURES[html]


def test_links_all_round_in_an_article():
    line = "<p>see <a href=a>this</a></p><p>plain</p><h2>Head</h2><p><a href=b>only this</a></p><div>bare</div>"
    assert o.main_text(f"<nav><a href=a>x</a></nav><article>{line * 20}</article>") == "\n".join(["see this", "plain", "Head", "only this", "bare"] * 20)


def test_deep_pages_take_linear_time():
    deep = "<div>" * 60_000 + "</span></table></article></li>" * 60_000 + "<li>" * 20_000 + "x"
    began = time.perf_counter()
    o.blocks(deep)
    assert time.perf_counter() - began < 20


def accuracy(names):
    x, y = o.table(seed=77, renderings=30, names=names)
    return np.mean([o.accepts(o.tree(), row) == bool(label) for row, label in zip(x, y)])


def test_tree_on_other_renderings():
    """Of pages that it wasn't grown from; without the names of elements the neighbours must do."""
    assert accuracy((True,)) > 0.98 and accuracy((False,)) > 0.9
    used = set()

    def walk(at):
        if isinstance(at, tuple):
            used.add(o.FEATURES[at[0]])
            walk(at[2]), walk(at[3])

    walk(o.tree())
    assert {"words", "links", "words_before", "words_after", "links_before", "links_after"} <= used


def test_pages_without_names(spark, sf):
    """The pages at hand with all their named elements made plain ones: most of the articles' words, and few others."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    kept = lost = more = 0
    for r in rows:
        want = o.main_text(r["html"]).split("\n")
        plain = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")
        got = o.main_text(plain).split("\n")
        common = set(want) & set(got)
        kept, lost, more = (n + sum(len(b) for b in part) for n, part in zip((kept, lost, more), (common, set(want) - common, set(got) - common)))
    assert lost < 0.05 * (kept + lost) and more < 0.05 * kept
