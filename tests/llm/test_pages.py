"""Page operators on small tables."""

import pytest

PAGE = "<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style><script>var a='</p>';</script></head><body><header>Top of site</header><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>{open}<h1>The title</h1><p>First  paragraph &amp; <b>bold</b>text<br>next.</p><div class=\"ad\">Buy now</div><p>Second one &lt;here&gt; is longer than the first one.</p><form><label>Mail</label></form>{close}<aside>Related things</aside><section id='comments'><p>I liked this a great deal, thanks.</p></section><footer>&copy; us</footer></body></html>"
TEXT = "The title\nFirst paragraph & boldtext next.\nSecond one <here> is longer than the first one."
SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def test_main_text(spark):
    from plateaux.llm.html_content import extract_main_text

    named = PAGE.replace("{open}", "<article>").replace("{close}", "</article>")
    plain = PAGE.replace("{open}", "<div class='content'>").replace("{close}", "</div>")
    rows = [(i, "u", named, "x", "y") for i in range(5)] + [(10, None, plain, "x", "y"), (11, "u", None, "x", "y"), (12, "u", "", "x", "y"), (13, "u", "<nav>only menu</nav>", "x", "y"), (14, "u", named[:named.index("longer")], "x", "y"), (None, "u", "<article><p>a<p>b</article>", "x", "y")]
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0]["text"] == TEXT and got[0]["n_chars"] == len(TEXT) and got[10]["text"] == TEXT and got[10]["url"] is None
    assert got[11]["text"] == got[12]["text"] == got[13]["text"] == "" and got[14]["text"].endswith("Second one <here> is") and got[None]["text"] == "a\nb"
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    urls = [f"https://www.site{i}.example.com/en/{i}.html" for i in range(40)] + [f"http://blog.site{i}.example.com/en/{i}" for i in range(40)] + [f"http://a{i}.example.net/es/{i}" for i in range(40)] + [f"http://b{i}.example.com/fr/{i}?x=1&y={i}" for i in range(40)]
    odd = [None, "nothing", "HTTP://WWW.EXAMPLE.COM/en/x", "http://example.com/en/", "http://net/fr/1", "http://xnet/fr/1", "http://example.com", "x://a.com/#/en/", "http://www.example.com/en/", "http://free.example.org/a?b=c#d"]
    return spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + odd)], "page_id long, url string, verdict int")


def test_url_rules_and_trees(spark, pages):
    from plateaux.llm.url_filter import RULES, judge

    rows = {r["page_id"]: r for r in pages.collect()}
    got = {r["page_id"]: r for r in judge(pages).collect()}
    assert len(got) == len(rows)
    for i, r in rows.items():
        u = r["url"] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:end].lower(), rest[end:]
            path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict or rule is None and got[i]["verdict"] in ("allow", "block")
    assert judge(pages.where("page_id < 0")).count() == 0
    assert {r["verdict"] for r in judge(pages.where("url is null")).collect()} == {"allow"}


BODY = "<h1>The title here</h1><p>" + "first paragraph of the story with many words in it " * 3 + "</p><p>" + "second paragraph goes on for quite a while as well " * 3 + "</p>"
LAYOUTS = {
    "plain": "<div id='content'>{}</div>",
    "wrapper": "<div id=content class='with-sidebar'>{}</div>",
    "denied": "<div class='post no-comments'>{}</div>",
    "container": "<div class='container search-page'><div class='entry'>{}</div></div>",
    "two wrappers": "<section class='layout has-menu sidebar'><div>{}</div></section>",
    "table": "<table><tr><td>{}</td></tr></table>",
}
EXTRAS = [
    ("<div class='entry-header'><h2>Kept heading of the story</h2></div>", "Kept heading of the story"),
    ("<section id='related-work'><p>" + "this section on earlier work belongs to the text itself " * 3 + "</p></section>", "earlier work belongs"),
    ("<figure><img src='x'><figcaption>A caption under the picture</figcaption></figure>", "A caption under the picture"),
    ("<p>Formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> stands here in the text of the story.</p>", "Formula x=2 stands"),
    ("<p>Press the <button>start</button> button and read the <label>label</label> in the text.</p>", "Press the start button and read the label in"),
]
AROUND = "<nav><ul>" + "".join(f"<li><a href='/{k}'>menu item {k}</a></li>" for k in range(12)) + "</ul></nav>{}<aside><p>a sidebar with some words</p></aside><div class='comments'><p>I liked this a great deal, thanks to all.</p></div><footer>Copyright of somebody and others</footer>"


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts(layout):
    from plateaux.llm.html_content import Counter, Weights, counts_of, main_text

    counts = Counter()
    for k in range(40):  # labelled pages of a single plain kind
        counts.update(counts_of("<html><body>" + AROUND.format("<article>" + BODY + "</article>") + "</body></html>"))
    weights = Weights(counts)
    text = main_text("<html><body>" + AROUND.format(LAYOUTS[layout].format(BODY)) + "</body></html>", weights)
    assert text.split("\n")[0] == "The title here" and text.count("second paragraph") == 3 and len(text.split("\n")) == 3
    for extra, said in EXTRAS:
        text = main_text("<html><body>" + AROUND.format(LAYOUTS[layout].format(BODY + extra + BODY)) + "</body></html>", weights)
        assert said in text and text.count("The title here") == 2 and "menu item" not in text and "I liked" not in text and "sidebar with" not in text and "Copyright" not in text


def test_best_region_against_all_regions():
    import random

    from plateaux.llm.html_content import best_region

    r = random.Random(5)
    for _ in range(300):
        scores = [(-r.random() * 2, r.uniform(-3, 3)) for _ in range(r.randrange(9))]
        total = lambda i, j: sum(own for _, own in scores[i:j + 1]) + sum(b for b, _ in scores[i + 1:j + 1])
        every = {(i, j): total(i, j) for i in range(len(scores)) for j in range(i, len(scores))}
        found = best_region(scores)
        best = max([0.0, *every.values()])
        assert (found == (0, -1) and best <= 0) or abs(every[found] - best) < 1e-9


def test_hostile_and_very_long_pages_take_time_in_proportion():
    import time

    from plateaux.llm.html_content import Weights, main_text

    start = time.time()
    for page in ('<a "' * 250_000, "<a b='" * 160_000, "<div class=\"" * 80_000, "<" * 10**6, "<div>" * 200_000, "</p>" * 250_000, "<!--" * 250_000, "<script>" * 120_000, "<p>word " * 120_000, "&amp;" * 200_000, "<b id=x>" * 120_000 + "</i>" * 1000, "<a b=\"'" * 140_000 + ">", f'<div class="{" ".join(f"name{i}" for i in range(60_000))}">' + "<p>some words of it</p>" * 20_000, "<p>word " * 100 + "<section class=ad>" * 40_000 + "<p>word " * 40_000):
        main_text(page, Weights({}))
    assert time.time() - start < 60


def test_articles_at_any_depth():
    from plateaux.llm.html_content import Weights, blocks_of, main_text

    body = "<p>" + "Many plain words of an article stand here one after another for whoever reads it. " * 4 + "</p>"
    page = "<div>" * 1000 + "<nav><p>Home</p><p>Contact</p></nav><article>" + body * 3 + "</article>" + "</div>" * 1000
    blocks, _, named = blocks_of(page)
    assert named == 1 and [b.element.inside for b in blocks] == [False, False, True, True, True]
    assert [b.element.landmark for b in blocks[:2]] == ["nav", "nav"]
    assert main_text(page, Weights({})).count("\n") == 2 and "Home" not in main_text(page, Weights({}))


def test_trees_tell_verdicts_of_hosts_they_did_not_see(pages):
    from plateaux.llm.url_filter import held_out_accuracy

    assert held_out_accuracy(pages) > 0.8
