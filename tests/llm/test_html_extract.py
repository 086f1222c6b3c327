import random
import time

from quire.llm import html_extract
from quire.llm.html_extract import extract, main_text

PROSE = "It was, all told, a long and winding sentence, with commas, clauses and a length that prose has but menus have not."


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy, buy, buy.</div>
    <div id="cookie-notice"><p>{PROSE}</p></div><article><h1>The&nbsp;title</h1><p><b>{PROSE} &amp; more<br>next
    line<p>Second   &lt;p&gt; paragraph &#233;</p><ul><li>one<li>two</ul><aside>no</aside><form><p>no</p></form></article>
    <div class="sidebar"><p>{PROSE}</p></div><section class="user-comments"><p>{PROSE}</p><p>{PROSE}</p></section><footer>&copy; no</footer></body></html>"""
    assert main_text(page) == f"The title {PROSE} & more next line Second <p> paragraph é one two"


def test_container_is_found_without_semantic_elements():
    rows = "".join(f"<p>{PROSE} Number {i}.</p>" for i in range(4))
    links = "<ul>" + "".join(f'<li><a href="/{i}">Some, link, text {i}</a></li>' for i in range(30)) + "</ul>"
    page = f"<html><body><div class=top>{links}</div><div><div class='text'><h2>Head</h2>{rows}</div><div>{links}</div></div></body>"
    want = "Head " + " ".join(f"{PROSE} Number {i}." for i in range(4))
    assert main_text(page) == want
    assert main_text(f"<div>{PROSE}<br/>{PROSE}</div>") == f"{PROSE} {PROSE}"
    assert main_text("just text &amp; no tags") == "just text & no tags"


def test_broken_and_hostile_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<nav>x</nav>") == ""
    assert main_text("<article><p>short<br></article>") == "short"
    assert main_text("<article><p title='a > b'>x <b>y</p></b> z") == "x y z"
    assert main_text('<article><p title="never closed>a</p><p>b</p></article>').endswith("b")
    began = time.time()
    main_text("<b>" * 100_000 + "x" + "</i>" * 100_000)
    main_text("<p><div>" * 50_000)
    main_text('<a href="' * 20_000)
    main_text("<li>a" * 50_000)
    assert time.time() - began < 20


def test_rows(spark):
    data = [(1, "u", "<article><p>Ünï</p></article>", 5), (1, "u", "<article><p>Ünï</p></article>", 5), (2, None, None, 6), (None, "v", "", 7)]
    out = extract(spark.createDataFrame(data, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, "u", "Ünï", 3)] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_nothing_of_an_article_is_lost():
    page = lambda body: main_text(f"<body><nav>no</nav><article>{body}</article><footer>no</footer></body>")
    for attribute in ('href="/hidden-gems"', 'title="a hidden thing"', 'data-hidden="false"', 'data-id="comment-1"', "title='class=advert'", "data-role=navigation", 'class="" class="advert"'):
        assert page(f"<p {attribute}>{PROSE}</p>") == PROSE, attribute
    for attribute in ("hidden", 'HIDDEN=""', 'class="a advert"', "style='color: red; display : none'", "role=navigation", 'aria-hidden="true"'):
        assert page(f"<p {attribute}>no</p><p>{PROSE}</p>") == PROSE, attribute
    assert page(f"<p>{PROSE}</p><svg viewBox='0'/><p>after</p>") == f"{PROSE} after"
    assert page(f"<p>{PROSE} <math><mi>x</mi><mo>+</mo></math> y</p>") == f"{PROSE} x+ y"
    assert page(f"<header><div><div><h1>Deep</h1></div><p>by line</p></div><h2>Second</h2></header><p>{PROSE}</p>") == f"Deep Second {PROSE}"
    links = '<ul><li><a href="/1">Source one</a></li><li><a href="/2">Source two</a></li></ul>'
    assert page(f"<p>{PROSE}</p>{links}") == f"{PROSE} Source one Source two"
    assert page(f'<p data-x="{"a > b " * 3000}">{PROSE}</p>') == PROSE
    long = f"{PROSE} " * 20_000
    assert page(f"<p>{long}</p>") == long.strip()


def test_names_of_wrappers_do_not_take_the_article():
    body = f"<h1>Head</h1><p>{PROSE}</p><p>Short.</p>"
    want = f"Head {PROSE} Short."
    for attribute in ('class="has-sidebar"', 'class="no-sidebar wide"', 'id="page-with-footer"', 'class="layoutWithMenu"', 'class="content-widget"', 'class="page share-links"', 'id="subscription-page"'):
        assert main_text(f"<body><nav>no</nav><div {attribute}><div>{body}</div></div></body>") == want, attribute
        assert main_text(f"<body><div {attribute}><main>{body}</main><footer>no</footer></div></body>") == want, attribute
    assert main_text(f'<body><div class="widget"><p>{PROSE}</p></div></body>') == PROSE
    assert main_text(f'<body><div class="masthead"><h1>Site</h1></div><div><p>{PROSE}</p></div></body>') == PROSE
    assert main_text(f'<body><div class="comments"><p>{PROSE}</p></div></body>') == ""


def test_form_around_the_page():
    body = f"<header><h1>Site</h1></header><article><p>{PROSE}</p><form><label>Name</label><p>no</p></form></article><footer>no</footer>"
    assert main_text(f'<body><form id="all" method=post>{body}</form></body>') == PROSE
    assert main_text(f"<body><form><fieldset><nav>no</nav><div><p>{PROSE}</p></div></fieldset></form></body>") == PROSE
    assert main_text(f"<body><form><p>{PROSE}</p></form><article><p>{PROSE}</p></article></body>") == PROSE
    assert main_text(f"<article><p>{PROSE}</p><object data=x><p>Instead of it.</p></object></article>") == f"{PROSE} Instead of it."


def test_short_siblings_of_the_best_container():
    links = '<div><a href="/1">One</a> <a href="/2">Two</a></div>'
    assert main_text(f"<body><div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>The end.</p></div>{links}</div></body>") == f"{PROSE} {PROSE} The end."
    assert main_text("<body><section><p>First part.</p></section><section><p>Other part.</p></section></body>") == "First part. Other part."


def test_points_of_small_trees_by_recursion():
    """Scores of random trees of div, p and a: a paragraph gives its points to its parent and half of them to its
    grandparent."""
    r = random.Random(8)

    def tree(depth):
        tag = r.choice(["div", "p"]) if depth else "div"
        kids = []
        for _ in range(r.randrange(1, 4)):
            kids.append("x" * r.randrange(1, 70) + "," * r.randrange(3) if tag == "p" or r.random() < 0.3 else ("a", ["y" * r.randrange(1, 30)]) if r.random() < 0.3 or depth > 2 else tree(depth + 1))
        return tag, kids

    def text(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(text, node[1]))}</{node[0]}>"

    def expected(node, parent, grand, out, linked=False):
        tag, kids = node
        size = sum(len(k) if isinstance(k, str) else 0 for k in kids)
        inner, link, commas, mine = size, size if linked else 0, sum(k.count(",") for k in kids if isinstance(k, str)), len(out)
        out.append(0.0)
        for k in kids:
            if not isinstance(k, str):
                s, n, c = expected(k, mine, parent, out, linked or k[0] == "a")
                size, link, commas = size + s, link + n, commas + (c if k[0] == "a" else 0)
        points = (1 + commas + min(size / 100, 3)) * (1 - link / max(1, size))
        if tag == "p" and size and parent is not None:
            out[parent] += points
            if grand is not None:
                out[grand] += points / 2
        elif tag == "div" and inner >= 80:
            out[mine] += points
            if parent is not None:
                out[parent] += points / 2
        return size, link, commas

    for _ in range(300):
        t = tree(0)
        root = html_extract.parse(text(t))
        html_extract._settle(root, True)
        order = html_extract._score(root)
        out = []
        expected(t, None, None, out)
        assert [round(x.score, 6) for x in order[1:]] == [round(x, 6) for x in out]
