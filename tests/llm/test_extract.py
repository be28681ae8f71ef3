import html
import random
import re

import pytest

from oddsframe.llm import extract as X
from tests.llm.helpers import words

SCHEMA = "page_id long, url string, html string"
HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x='</p>';</script></head><body>"


def texts(spark, rows):
    return {r.page_id: r.text for r in X.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def template(i, blocks, extra=""):
    nav = "".join(f"<li><a href='/{i}{k}'>menu {i} {k}</a></li>" for k in range(1 + i % 4))
    body = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
    return f"{HEAD}<header>Site</header><nav><ul>{nav}</ul></nav><div class='ad'>Buy {i}</div><article><h1>Title {i}</h1>{body}{extra}</article><aside>side</aside><footer>&copy; host</footer></body></html>"


def test_pages_of_a_template(spark):
    r, rows, want = random.Random(1), [], {}
    for i in range(60):
        blocks = [f"Block {i} {k} a&b <c> \"d\" ünï" for k in range(r.randint(1, 6))]
        rows.append((i, f"http://h{i % 3}.org/{i}", template(i, blocks)))
        want[i] = "\n".join([f"Title {i}", *blocks])
    assert texts(spark, rows) == want


def test_hosts_without_article_element(spark):
    page = lambda i: f"{HEAD}<div id='top'><a href='/'>Home</a> <a href='/x'>X</a></div><div class='wrap'><div class='content'><h2>Head {i}</h2>{''.join(f'<p>Long enough paragraph number {i} {k} with words.</p>' for k in range(3 + i % 3))}</div></div><div class='bottom'>All rights reserved</div></body></html>"
    out = texts(spark, [(i, "https://one.example/p", page(i)) for i in range(8)])
    for i in range(8):
        assert out[i] == "\n".join([f"Head {i}", *[f"Long enough paragraph number {i} {k} with words." for k in range(3 + i % 3)]])


def test_what_never_is_main_text(spark):
    extra = "<form><input>Sign up</form><div class='share-buttons'>Share</div><section id='comments'><p>First!</p></section><div class='cookie-notice'>Cookies</div><p style='display: none'>hidden</p><noscript>no</noscript><!-- not <p>this</p> --><ul><li>one<li>two</ul>"
    assert texts(spark, [(1, "http://a.b/1", template(1, ["Body"], extra))])[1] == "Title 1\nBody\none\ntwo"


def test_gadgets_in_a_line_and_headers_by_name(spark):
    page = "<div class='header'>Site <p>slogan</p></div><div id='sidebar-left'>s</div><article><div class='header'><h1>T</h1></div><p>press <button>OK <b>now</b></button>to <svg><text>x</text></svg>go<p>unclosed <select><option>a<p>still in it</article><div class='reader-comments'>c</div>"
    assert texts(spark, [(1, "http://a.b/1", page)])[1] == "T\npress to go\nunclosed"
    assert texts(spark, [(1, "http://a.b/1", "<p>a<video src=x />b<canvas>no</canvas></p><div class='notice'>n</div><p>c")])[1] == "ab\nc"


def test_white_space_references_and_broken_markup(spark):
    rows = [
        (1, "http://x/1", "<article><p>a&nbsp;&nbsp;b\n\t c<br>d &lt;e&gt; &#233; &#x1F600; &amp;amp; &copy g <b>bold<i>it</p><p>next"),
        (2, "http://x/2", "<article><p>cut <b>in the mid"),
        (3, "http://x/3", "<article><p>cut in a tag <a hre"),
        (4, "http://x/4", None), (5, None, ""), (6, None, "plain text only"), (7, "http://x/7", "<p>" * 500 + "deep" + "<div>" * 500 + "deeper"),
    ]
    out = texts(spark, rows)
    assert out[1] == "a b c d <e> é 😀 &amp; © g boldit\nnext"
    assert (out[2], out[3], out[4], out[5], out[6], out[7]) == ("cut in the mid", "cut in a tag", "", "", "plain text only", "deep\ndeeper")


def test_hot_host_merges_in_parts_and_columns(spark, monkeypatch):
    monkeypatch.setattr(X, "FAN", 4)
    rows = [(i, "http://hot.example/x", template(i, [f"b {k}" for k in range(i % 9)], "<table><tr><td>c</table>" * (i % 2))) for i in range(40)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", text string")
    out = X.extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == 40 and all(r.n_chars == len(r.text) for r in got.values()) and got[3].text.startswith("Title 3\nb 0\nb 1\nb 2\nc")


def test_empty_table(spark):
    assert X.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def tree(text):
    return X.wrapper_of(X.parse(text))


def flags(w):
    return [(X._id(c), c[1]) for c in w[3]]


def test_mismatches_become_optional_repeated_and_slots():
    a, b = tree("<h1>same</h1><p>one</p><hr><ul><li>x</ul>"), tree("<h1>same</h1><p>one</p><p>two</p>")
    w = X.merged(a, b)
    assert flags(w) == [("h1", "1"), ("p", "+"), ("ul", "?")]
    assert w[3][0][3][0][3] is not None and w[3][1][3][0][3] is None  # a fixed text, and a slot


def test_groups_of_elements_repeat_together():
    w = X.merged(tree("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"), tree("<h2>e</h2><p>f</p>"))
    assert [(c[0], c[1]) for c in w[3]] == [("(", "+")] and [c[0] for c in w[3][0][3]] == ["h2", "p"]


def test_wrappers_stay_bounded():
    w = tree("".join(f"<div class='k{chr(97 + i // 26)}{chr(97 + i % 26)}'>t</div>" for i in range(600)))
    assert len(w[3]) == 1 and w[3][0][1] == "*"


def test_a_host_with_many_kinds_of_pages_keeps_its_article_and_own_texts(spark):
    name = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}"
    page = lambda i: f"<html><body class='category-{name(i)}'><div class='box'><p>From the host</p></div><div class='story'><article><p>Text {i}</p></article></div></body></html>"
    assert texts(spark, [(i, "http://many.example/p", page(i)) for i in range(49)]) == {i: f"Text {i}" for i in range(49)}
    plain = lambda i: f"<div class='box'>From the host</div><div class='k-{name(i)}'>{i}</div><div class='story'><p>A text of some length, number {i}, in many words that weigh more</p></div>"
    out = texts(spark, [(i, "http://plain.example/p", plain(i)) for i in range(48)])
    assert not any("From the host" in x for x in out.values()) and all(f"number {i}, in" in x for i, x in out.items())


def test_deep_elements_are_closed_and_dropped(spark):
    deep = "<div>" * 80 + "<p>in</p><nav>menu</nav><section id='comments'><div>c</div></section>between" + "</div>" * 80
    rows = [(1, "http://d/1", f"<body><article><p>first</p>{deep}<p>last</p></article><p>outside</p></body>"), (2, "http://e/2", "<div>" * 90 + "<p>no</p><article><p>yes</p><aside>no</aside></article>" + "</div>" * 90 + "<p>no</p>")]
    assert texts(spark, rows) == {1: "first\nin\nbetween\nlast", 2: "yes"}


def test_very_deep_pages_take_linear_time():
    root = X.parse("<div>" * 100_000 + "x" + "</b></section>" * 10 + "</div>" * 100_000)
    assert X.read(root, None) == "x"


def test_the_wrapper_takes_fixed_texts_out_and_leaves_slots(spark):
    page = lambda i: f"<article><div class='lead'>Welcome to our corner</div><h1>Head {i}</h1><p>Story number {i} goes on for some words here.</p><div class='end'>Powered by this and that</div></article>"
    out = texts(spark, [(i, "http://fix.example/p", page(i)) for i in range(10)] + [(99, "http://other.example/p", page(99))])
    assert all(out[i] == f"Head {i}\nStory number {i} goes on for some words here." for i in range(10))
    # one page alone can't tell, so its text is whole
    assert out[99] == "Welcome to our corner\nHead 99\nStory number 99 goes on for some words here.\nPowered by this and that"


def test_copies_of_one_article_stay_whole_and_rows_repeat(spark):
    page = "<body><nav>menu</nav><article><h1>One</h1><p>and the same</p></article></body>"
    got = X.extract_main_text(spark.createDataFrame([(k // 2, "http://same.example/p", page) for k in range(12)], SCHEMA)).collect()
    assert len(got) == 12 and {r.text for r in got} == {"One\nand the same"}


def test_quotes_in_attributes(spark):
    rows = [(1, "http://q/1", "<p data-x=it's>one</p><p>two don't</p>"), (2, "http://q2/1", '<p title="a>one</p><p>two</p>'), (3, "http://q3/1", '<p title="a>b" class=x>one</p>'), (4, "http://q4/1", "<p a='>' b=\">\" c = '>'>x</p>")]
    assert texts(spark, rows) == {1: "one\ntwo don't", 2: "one\ntwo", 3: "one", 4: "x"}


def test_long_class_lists_stay_apart(spark):
    long = "a" * 60
    page = lambda i: f"<article><div class='{long}x'>Same {i % 2}</div><div class='{long}y'>Fixed words</div><p>Body {i} with enough words to be most of it all</p></article>"
    assert X._kind("div", f" class='{long}x'")[0] != X._kind("div", f" class='{long}y'")[0]
    assert texts(spark, [(i, "http://l/1", page(i)) for i in range(6)])[3] == "Same 1\nBody 3 with enough words to be most of it all"


def test_a_very_long_page_and_many_readings(spark, monkeypatch):
    monkeypatch.setattr(X, "SENT", 0)
    rows = [(1, "http://x/1", "<article>" + "<p>some words</p>" * 100_000 + "</article>"), (2, None, "<p>a"), (3, "http://x/2", "<article><p>b</article>")]
    out = texts(spark, rows)
    assert (len(out[1]), out[2], out[3]) == (100_000 * 11 - 1, "a", "b")


def expression(children):
    """A wrapper's children as a regular expression over their names."""
    one = lambda x: f"(?:{expression(x[3])})" if x[0] == "(" else f"(?:{x[0]};)"
    return "".join(one(x) + x[1].replace("1", "") for x in children)


def common(a, b):
    """The length of the longest common subsequence, by trying all of a's."""
    best = 0
    for mask in range(1 << len(a)):
        part, rest = [x for i, x in enumerate(a) if mask >> i & 1], iter(b)
        if len(part) > best and all(x in rest for x in part):
            best = len(part)
    return best


def test_alignment_equals_brute_force():
    r = random.Random(11)
    for _ in range(300):
        # neighbours differ, so no repetitions: what two pages share is their longest common subsequence
        a, b = ([x for i, x in enumerate(s) if not i or s[i - 1] != x] for s in ([r.choice("abcdef") for _ in range(r.randint(1, 7))] for _ in range(2)))
        if any(s[i : i + n] == s[i + n : i + 2 * n] for s in (a, b) for n in (2, 3) for i in range(len(s))):
            continue
        lists = [[[x, "1", 1, []] for x in s] for s in (a, b)]
        got = X.aligned(*lists, False)
        assert all(re.fullmatch(expression(got), "".join(f"{x};" for x in s)) for s in (a, b))
        flat = [x for x in got if x[1] == "1"]
        if not any(x[0] == "(" or x[1] in "+*" for x in got):
            assert len(flat) == common(a, b) and len(got) == len(a) + len(b) - common(a, b)


def test_wrappers_accept_every_page_they_are_made_of():
    r = random.Random(12)
    for _ in range(200):
        pages = [[r.choice(["h1", "p", "ul", "table"]) for _ in range(r.randint(0, 8))] for _ in range(r.randint(2, 5))]
        out = None
        for s in pages:
            w = X.folded([[x, "1", 1, []] for x in s])
            out = w if out is None else X.aligned(out, w, False)
        for s in pages:
            assert re.fullmatch(expression(out), "".join(f"{x};" for x in s)), (pages, out)


NAMES = ["legal", "notice-board", "social-policy", "share-prices", "rail-travel", "discussion", "login-guide", "widget-store", "alert", "content"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("n", [1, 6])
def test_a_class_name_alone_drops_no_article(spark, name, n):
    rows = [(k, f"http://{name}.net/{k}", f"<html><body><div class='menu'><a href='/'>Home</a> Sections of the site</div><div class='{name}'><h1>Title {k}</h1><p>{words(k, 60)}</p><p>{words(k + 50, 60)}</p></div><div class='footer'>All rights</div></body></html>") for k in range(n)]
    out = {r.page_id: r.text for r in X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"Title {k}\n{words(k, 60)}\n{words(k + 50, 60)}" for k in range(n)}


def test_a_section_with_most_of_an_article_stays_and_comments_go(spark):
    page = lambda k, inner, rest: f"<html><body><article><h1>T{k}</h1>{inner}</article>{rest}</body></html>"
    long, short = (lambda k: f"<p>{words(k, 90)}</p>"), (lambda k: f"<p>{words(k + 500, 12)}</p>")
    rows = [(k, "http://a.net/x", page(k, f"<section class='discussion'>{long(k)}</section>", "")) for k in range(4)]
    rows += [(10 + k, "http://b.net/x", page(k, f"{long(k)}<section class='related'>{short(k)}</section>", f"<div class='comments'>{long(k + 70)}{long(k + 80)}</div>")) for k in range(4)]
    out = {r.page_id: r.text for r in X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"T{k}\n{words(k, 90)}" for k in range(4)} | {10 + k: f"T{k}\n{words(k, 90)}" for k in range(4)}


def test_an_odd_page_of_a_host_is_judged_by_itself(spark):
    rows = [(k, "http://c.net/x", f"<body><div class='{'legal' if k == 3 else 'content'}'><p>{words(k, 80)}</p></div></body>") for k in range(8)]
    out = {r.page_id: r.text for r in X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: words(k, 80) for k in range(8)}
