"""The tag scan and the element stack of operator 10, without Spark."""

import html
import random
import re
import time

import pytest

from marquee.llm.markup import blocks


@pytest.mark.parametrize("page, main, beside", [
    ('<article><ul><li class="ad">x<li>y</ul><p>Body</p></article>', ["y", "Body"], ["x"]),
    ('<article><table><tr><td class="promo">a<td>b<tr><td>c</table>t</article>', ["b", "c", "t"], ["a"]),
    ('<article><dl><dt class="widget">q<dd>w</dl>z</article>', ["w", "z"], ["q"]),
    ('<body><div class="notice">n<article><p>Body</p></article>', ["Body"], ["n"]),
    ('<article><section><div class="notice">n</section><p>Body</p></article>', ["Body"], ["n"]),
    ('<article><div class="article-header"><h1>Title</h1><p>Lead</p></div></article>', ["Title", "Lead"], []),
    ('<article><section id="related-work">R</section><h2 id="search-results">S</h2></article>', ["R", "S"], []),
    ('<article>a<div class="ad-slot">x</div><ol class="comment-list"><li>c</ol></article>', ["a"], ["x", "c"]),
    ('<nav><article>no</article></nav><article>yes <span class=ad>no <b>no</b></span> yes</article>', ["yes", "yes"], ["no", "no no"]),
    ('<article><ul><li>a<ul><li class=ad>b</ul><li>c</ul></article>', ["a", "c"], ["b"]),
    ("<article><p>a</div>b</article></article>c", ["a", "b"], []),
])
def test_elements_end_where_html_ends_them(page, main, beside):
    assert blocks(page)[0] == main and blocks(page)[2] == beside


@pytest.mark.parametrize("page, text", [
    ('<p title="a > b">x</p>', ["x"]), ("<a title=it's>q</a> don't <b>z</b>", ["q don't z"]), ("a < b <c", ["a < b <c"]),
    ("<svg/>a<svg><p>x</svg>b", ["ab"]), ("a<!-->b<!-- c", ["ab"]), ("<script>'</p>'</script >x", ["x"]), ("", []), ("<title>t", []),
    ('<p class="x>y</p><p>z', ["y", "z"]),
])
def test_scan(page, text):
    assert blocks(page) == ([], text, [])


def test_time_grows_with_the_page():
    for unit in ("<script ", "<a ", '<a ="', '<a ="x>', "<li><b>", "<b></i>", "<!--", "</script ", "<div><p></b>", "<li><ul><b></li>", "<a ='\">"):
        spent = []
        for n in (5_000, 20_000):
            page = "<p>" + unit * n
            start = time.process_time()
            blocks(page)
            spent.append(time.process_time() - start)
        assert spent[1] < 12 * spent[0] + 0.2, (unit, spent)  # 16 times and more if it grew with the square


def test_well_formed_pages_equal_a_recursive_reading():
    """Random trees of elements that all have their end tags, against a walk over the tree itself."""
    draw = random.Random(7)

    def tree(depth):
        if depth == 0 or draw.random() < 0.3:
            return f"{draw.choice('abcdef')}{draw.randrange(99)} &amp;\n "
        name, mark = draw.choice(["div", "section", "article", "b", "nav", "ul", "span"]), draw.choice(["", "", "", ' class="ad"', " hidden"])
        return name, mark, [tree(depth - 1) for _ in range(draw.randrange(4))]

    def write(node):
        return node if isinstance(node, str) else f"<{node[0]}{node[1]}>{''.join(map(write, node[2]))}</{node[0]}>"

    def walk(node, zone, out):
        if isinstance(node, str):
            out.append((zone, html.unescape(node)))
            return
        name, mark, children = node
        inner = zone if zone == 2 else 2 if mark or name == "nav" else 0 if name == "article" else zone
        block = name not in ("b", "span") or (inner == 2 and zone != 2)
        out.extend([None] * block)
        for child in children:
            walk(child, inner, out)
        out.extend([None] * block)

    for _ in range(500):
        nodes = [tree(6) for _ in range(3)]
        out = []
        for node in nodes:
            walk(node, 1, out)
        want, run = ([], [], []), []
        for item in [*out, None]:
            if item is not None:
                run.append(item)
            elif run:
                text = re.sub(r"\s+", " ", "".join(t for _, t in run)).strip()
                if text:
                    want[run[0][0]].append(text)
                run = []
        assert blocks("".join(map(write, nodes))) == want
