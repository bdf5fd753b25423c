import random
import time

from semblance.llm import html as H


def page(i, body, shell="div"):
    return f"<html><head><title>t{i}</title><script>var x='<p>no</p>';</script></head><body><ul><li><a href=/a>menu {i}</a><li><a href=/b>more {i}</a></ul><{shell}>{body}</{shell}><div><p>All rights reserved</p></div></body></html>"


def test_main_text_of_one_page():
    assert H.hinted_text(None) == H.hinted_text("") == ""
    assert H.hinted_text("plain &amp; text") == "plain & text"
    assert H.hinted_text("<article><h1>T</h1><p>a<b>b</b>c &lt;x&gt;<br>d<p>e&nbsp; \n f</article><p>out") == "T abc <x> d e f"
    assert H.hinted_text("<body><header>no</header><nav>no</nav><main><p>yes<aside>no</aside><div class='reader-comments'>no</div><form>no</form></main><footer>no</footer>") == "yes"
    assert H.hinted_text("<div id='cookie-notice'>no</div><p style='display:none'>no</p><p>yes</p><div class=ad>no</div>") == "yes"
    assert H.hinted_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert H.hinted_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(H.hinted_text("<p>" + "word " * 200_000)) == 5 * 200_000 - 1


def test_wrapper_of_a_host(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"<p>story {i}</p><p>and {i * i} end</p>")) for i in range(12)]
    rows += [(100, "http://one.org/", page(0, "<p>alone</p>")), (101, None, None), (102, "http://h.org/", ""), (103, "http://h.org/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.main_text(df.selectExpr("*", "'x' AS host", "1 AS text")).collect()}
    assert len(got) == len(rows)
    for i in range(12):  # the constant line and the menu are template, what varies is content
        assert got[i] == f"story {i} and {i * i} end"
    assert got[103] == got[0] and got[101] == got[102] == ""
    assert got[100] == "menu 0 more 0 alone All rights reserved"  # one page of a host shows no template
    assert H.main_text(df.limit(0)).count() == 0


def _best(a, b):
    """The largest match by trying all, with the parents matched."""
    if a.sign != b.sign:
        return 0

    def lists(xs, ys):
        if not xs or not ys:
            return 0
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), _best(xs[0], ys[0]) + lists(xs[1:], ys[1:]))

    return 1 + lists(a.children, b.children)


def _tree(rng, depth=0):
    tag = rng.choice(["div", "ul", "section"])
    return f"<{tag}>" + "".join(_tree(rng, depth + 1) if depth < 2 else rng.choice(["<p>x</p>", "<h2>y</h2>", "t"]) for _ in range(rng.randrange(4))) + f"</{tag}>"


def test_matching_against_all_matches():
    a, b = (H.fold(H.parse(x))[0] for x in ("<div><p>1<ul><li>2</ul><p>3</div>", "<div><ul><li>x</ul><h2>y</h2><p>z</div>"))
    assert H.simple_tree_matching(a, b) == len(H.matched(a, b)) == 5  # root, div, ul, li, and the last p
    rng = random.Random(3)
    for _ in range(150):
        a, b = (H.fold(H.parse(_tree(rng) + _tree(rng)))[0] for _ in range(2))
        pairs = H.matched(a, b)
        assert H.simple_tree_matching(a, b) == len(pairs) == _best(a, b)
        at = [{x.index: x for x in H._each(t)} for t in (a, b)]
        up = [{c.index: x.index for x in H._each(t) for c in x.children} for t in (a, b)]
        for x, y in pairs.items():
            assert at[0][x].sign == at[1][y].sign and (x == 0 or pairs[up[0][x]] == up[1][y])


def test_many_alternating_siblings():
    long = lambda n, t: "<div>" + "".join(f"<p>{t}{i}</p><h2>{i}</h2>" for i in range(n)) + "</div>"
    began = time.time()
    for n, m in ((1600, 1500), (4000, 3999)):
        blocks = H.aligned(long(n, "a") + "<ul><li>x</ul>", "<b>odd</b>" + long(m, "b"))
        assert len(blocks) == 2 * n + 1 and sum(b[0] >= 0 for b in blocks) >= 2 * m
    hard = "<div>" + "".join(f"<p>{i}<i></i></p><h2>{i}</h2>" + "<section><p></p></section>" * (i % 2) for i in range(900)) + "</div>"
    assert H.aligned(hard, hard.replace("section", "ul"))
    assert time.time() - began < 30


def test_hints_on_the_whole_page_are_not_taken():
    assert H.hinted_text("<body><form><nav>no</nav><article><p>yes</article></form>") == "yes"
    assert H.hinted_text("<body><div class='page-login'><p>" + "long text " * 20 + "</div><div class='login'>no</div>") == " ".join(["long text"] * 20)
    # beyond the levels of a tree, flags and order stay
    deep = "<blockquote>" * 150 + "a<script>no</script>b<nav>no</nav>c<div>d</div>e" + "</blockquote>f" * 3
    assert H.hinted_text(deep) == "a b c d e f f f"


def test_content_by_the_alignment_alone(spark):
    """No name says where the article is: menus, adverts, notices and comments vary as it does."""
    def neutral(i, shell):
        return (f"<body><div><ul><li><a href=/{i}>m{i}</a><li><a href=/x{i}>n{i} on</a></ul></div><div>buy {i} now</div>"
                f"<{shell}><h1>title {i}</h1><p>{'word ' * 30}{i}</p><p>and {i * i} more</p></{shell}><div><div>site {i}</div><div><p>note {i}</p></div></div></body>")

    rows = [(i, f"http://h.org/{i}", neutral(i, "div")) for i in range(6)] + [(50 + i, f"http://g.org/{i}", neutral(i, "section")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == got[50 + i] == f"title {i} {'word ' * 30}{i} and {i * i} more"


def test_layouts_that_the_reference_lacks(spark):
    def other(i):
        return f"<html><body><section><p>Subscribe today</p><h2>note {i}</h2></section><section class=x><p><a href=/{i}>go {i} on</a></p></section></body></html>"

    rows = [(i, f"http://h.org/{i}", page(i, f"<p>story {i}</p><p>and {i * i} end</p>")) for i in range(12)]
    rows += [(100 + i, f"http://h.org/o{i}", other(i)) for i in range(12)]
    rows += [(200 + i, "http://copies.org/", "<body><p>one story</p>") for i in range(40)] + [(300, "http://copies.org/b", "<body><p>two</p>")]
    rows += [(400, "http://h.org/err", "<html><body><pre>gone</pre></body></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.main_text(df).collect()}
    for i in range(12):
        assert got[i] == f"story {i} and {i * i} end" and got[100 + i] == f"note {i}"
    # copies of one page show no template
    assert got[200] == "one story" and got[300] == "two" and got[400] == "gone"
