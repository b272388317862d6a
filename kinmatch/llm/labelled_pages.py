"""Labelled pages from which the tree of op10_html is grown.

Each page is a pattern: ``{a-b}`` stands for so many words, ``(x|y)`` for one of its choices and ``[x]*n`` for up to n
repeats of x, at least one. Blocks that belong to the article begin with ``§``. A rendering with names is the page as it
is; in one without, elements and attributes that name a part of the page are replaced by a plain div, so that the words
and links of a block and its neighbours are all there is to go by, and what can't be told from the article then (comments,
advertisements in paragraphs) is left out.
"""

from __future__ import annotations

import random
import re

PATTERNS = (
    # a news page
    "<header><a>{1-3}</a></header><nav><ul>[<li><a>{1-2}</a></li>]*8</ul></nav><article><h1>§{3-12}</h1><p>§{2-5}</p>[<p>§{15-90}</p>]*7"
    "<aside><h3>{2-4}</h3>[<p>{15-40}</p>]*2</aside>[<p>§{1-60}</p>]*5</article><div class=related><h3>{1-3}</h3><ul>[<li><a>{4-12}</a></li>]*6</ul></div>"
    "<footer>{4-20} <a>{1-2}</a> <a>{1-2}</a></footer>",
    # a blog with comments
    "<div class=topbar><a>{1-2}</a> <a>{1-2}</a></div><div class=post><header class=entry-header><h1>§{2-10}</h1></header>[<p>§{1-80}</p>]*8<p>§{1-3}</p></div>"
    "<section class=comments><h2>{1-3}</h2>[<div><b>{1-2}</b> <a>{1-1}</a></div><p>{3-90}</p>]*6</section><div class=sidebar>[<a>{1-4}</a><br>]*6</div><div>{3-8}</div>",
    # an article without any element of its own
    "<div><a>{1-2}</a> <a>{1-2}</a> <a>{1-2}</a></div><h1>§{3-12}</h1>[<p>§{20-90}</p>]*6(<h2>§{1-6}</h2><p>§{20-80}</p>|)[<p>§{25-80}</p>]*3(<p>§{1-9}</p>|)<div>{3-9}</div>",
    # a page of short paragraphs and dialogue
    "<nav>[<a>{1-2}</a> ]*6</nav><main><h1>§{1-8}</h1>[<p>§{1-14}</p><p>§{8-40}</p>]*9</main><footer>{3-15}<br><a>{2-4}</a></footer>",
    # advertisements and notices within the text
    "<div class=cookie-notice><p>{10-40}</p><button>{1-1}</button></div><article><h1>§{2-9}</h1>[<p>§{10-70}</p>]*3<p class=advert>{5-40}</p>[<p>§{5-70}</p>]*3"
    "<div class=ad>{6-30} <a>{1-3}</a></div><p>§{1-40}</p><p class=notice>{6-30}</p></article>",
    # lists and tables in the article
    "<ul class=menu>[<li><a>{1-3}</a></li>]*9</ul><article><h1>§{2-9}</h1><p>§{10-60}</p><ul>[<li>§{1-14}</li>]*6</ul><p>§{10-60}</p><table><tr>[<td>§{1-4}</td>]*5</tr></table>"
    "<blockquote>§{8-40}</blockquote><p>§{5-50}</p><div class=share>[<a>{1-1}</a> ]*4</div><p>§{5-50} <a>{1-4}</a></p></article><footer>{5-12}</footer>",
    # a portal: many links and teasers, no article
    "<ul>[<li><a>{1-3}</a></li>]*9</ul>[<div><a>{4-10}</a></div><div>{4-12} <a>{2-3}</a></div>]*7<div>{2-6}</div><div><a>{1-2}</a></div>",
    # long legal text and a form
    "<div><a>{1-2}</a></div><article><h1>§{2-8}</h1>[<p>§{30-90}</p>]*5<form><label>{1-3}</label><p>{6-30}</p></form></article><footer>{30-80}</footer>",
    # text in bare divs
    "<div><a>{1-2}</a> <a>{1-2}</a></div><div><h1>§{3-9}</h1></div>[<div>§{25-90}</div>]*6<div>{2-8}</div><div><a>{2-5}</a></div>",
    # links in running text, and lists of further reading after it
    "<nav>[<a>{1-2}</a> ]*5</nav><h1>§{2-9}</h1>[<p>§{15-50} <a>{1-4}</a> {10-40}</p>]*6<p>§{20-50}</p><h3>{1-3}</h3><ul>[<li><a>{3-9}</a></li>]*7</ul><div>{3-9} <a>{1-3}</a></div>",
    # nothing but an article, which may be very short
    "<article><h1>§{1-6}</h1>[<p>§{1-40}</p>]*4</article>",
    "<article>[<p>§{1-30}</p>]*4</article><footer>{1-6}</footer>",
    "<nav><a>{1-1}</a></nav><article><h1>§{1-3}</h1><p>§{1-4} <a>{1-2}</a></p><p>§{1-4}</p></article><footer>{1-2}</footer>",
    "<article><ul>[<li>§{1-3}</li>]*4</ul><table><tr>[<td>§{1-2}</td>]*4</tr></table><p>§{1-3}</p></article>",
    # text that ends with a short paragraph
    "<div><a>{1-1}</a> <a>{1-1}</a></div><h1>§{1-6}</h1>[<p>§{15-60}</p>]*5<p>§{1-6}</p>",
    "<div><a>{1-1}</a> <a>{1-1}</a></div><h2>§{1-6}</h2>[<p>§{20-60}</p><p>§{1-6}</p>]*3<p>§{15-50}</p><div class=comment-list>[<p>{3-60}</p>]*4</div><div>{2-6}</div>",
    # teasers under linked headings, and replies under a text
    "<ul>[<li><a>{1-3}</a></li>]*5</ul>[<h3><a>{4-10}</a></h3><p>{6-25}</p>]*8<div>{2-6}</div>",
    "<div><a>{1-2}</a> <a>{1-2}</a></div><h1>§{3-9}</h1>[<p>§{25-80}</p>]*5[<p>{1-2} <a>{1-2}</a></p><p>{3-30}</p>]*6<div>{2-6}</div>",
    "<div>[<a>{1-2}</a> ]*4</div>[<p>{1-3}</p><p><a>{2-6}</a></p>]*6<div>{3-7}</div>",
    # pages without a text: an error, a log-in, a list of short bare lines
    "{1-16}", "<div>{1-12}</div>[<div>{1-12}</div>]*6", "<div><a>{1-2}</a></div><div>{1-9}</div>[<div>{2-14}</div><div><a>{1-3}</a></div>]*4<div>{1-5}</div>",
    # a text in bare divs with short lines about it
    "<div>{1-4}</div><div><a>{1-2}</a></div><div>{1-5}</div><h1>§{3-9}</h1>[<div>§{25-80}</div>]*5<div>{1-9}</div><div>{1-9}</div>",
)
#: Pages that only names tell from others.
NAMED_PATTERNS = (
    "<div class=ad>{20-90}</div><article><h1>§{2-8}</h1>[<p>§{10-60}</p>]*4</article><div class=sidebar>{20-90}</div><div class=comments>[<p>{5-90}</p>]*6</div>",
    "<div>{20-90}</div><p>{20-90}</p><article><h1>§{2-8}</h1>[<p>§{10-60}</p>]*4</article>[<p>{5-90}</p>]*4<div>{20-90}</div><div>{20-90} <a>{1-4}</a></div>",
    "<div class=ad>{20-90}</div><h1>§{2-8}</h1>[<p>§{20-60}</p>]*4<aside>[<p>{20-60}</p>]*4</aside><div class=cookie-notice>{20-90}</div><footer>{20-90}</footer>",
    "<nav>[<a>{1-2}</a> ]*4</nav><article><h1>§{2-8}</h1>[<p>§{2-20} <a>{1-8}</a></p><p>§{1-30}</p><h2>§{1-5}</h2><p>§{1-6} <a>{1-3}</a></p>]*9</article><footer>{2-9}</footer>",
    "<main>[<p>§{1-9} <a>{1-9}</a></p><p>§{1-9}</p><div>§{1-9}</div><div><a>§{1-5}</a> {1-9}</div>]*9</main>",
    "<article>§{1-30}</article>", "<article><div>§{1-20}</div>[<div>§{1-40}</div>]*5</article><div>{2-9}</div>",
    "<nav>[<a>{1-2}</a> ]*4</nav><main><p><a>§{1-6}</a></p><p>§{1-9}</p>[<p>§{1-30}</p>]*4<p><a>§{2-8}</a></p></main><footer>{2-30}</footer>",
)
#: Elements and attributes that name a part of a page.
NAMED = re.compile(r"<(/?)(?:article|main|header|nav|footer|aside|form|section)\b[^>]*>|\s(?:class|id)=[\w-]+")
#: Parts whose text is like that of an article.
ALIKE = re.compile(r"<section class=comments>.*?</section>|<div class=(?:comment-list|ad|cookie-notice)>.*?</div>|<p class=(?:advert|notice)>.*?</p>|<form>.*?</form>|<aside>.*?</aside>")


def render(pattern: str, rng: random.Random, names: bool) -> str:
    """A page of the pattern, with lengths, choices and repeats by ``rng``."""
    out = re.sub(r"\[(.*?)\]\*(\d+)", lambda m: m[1] * rng.randint(1, int(m[2])), pattern)
    out = re.sub(r"\(([^()]*)\|([^()]*)\)", lambda m: m[rng.randint(1, 2)], out)
    out = re.sub(r"\{(\d+)-(\d+)\}", lambda m: " ".join(rng.choices(("of", "river", "stone", "mountains"), k=rng.randint(int(m[1]), int(m[2])))), out)
    if names:
        return out
    out = ALIKE.sub("", out)
    return NAMED.sub(lambda m: f"<{m[1] or ''}div>" if m[0][0] == "<" else "", out)


def pages(seed: int, renderings: int, names: tuple[bool, ...] = (True, False)) -> list[str]:
    """So many renderings of each pattern, with names and without."""
    rng = random.Random(seed)
    given = [*((p, n) for p in PATTERNS for n in names), *((p, True) for p in NAMED_PATTERNS if True in names)]
    return [render(p, rng, n) for p, n in given for _ in range(renderings)]
