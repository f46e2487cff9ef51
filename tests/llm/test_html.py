import math
import random
import time
from collections import Counter

import pytest

from tallstrip.llm.html import Params, extract, host_of, importances, main_text, nodes, style_tree

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>top</header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">buy</div><div id="cookie-notice">ok?</div>
<aside>side</aside><article><h1>Head &amp; shoulders</h1><p><b>One&nbsp;two<br>three<p>four <i>fi</i>ve
 six</p><form><input value="q">send</form><div class="share">tweet</div><section class="comments"><p>first!</p></section><!-- no --></article><footer>&copy; me</footer>"""


def test_presentation_alone():
    assert extract(PAGE) == "Head & shoulders One two three four five six"
    assert extract("") == "" and extract("plain 1 < 2 &lt; 3") == "plain 1 < 2 < 3"
    assert extract("<div>a</div><div>b<span>c</span></div>") == "a bc"
    assert extract("<p>a<!-- unclosed") == "a"
    assert extract("x<script>1</script>y<my-tag>z</my-tag><ul><li>1<li>2</ul>") == "xyz 1 2"


def test_a_wrapper_s_name_does_not_hide_its_article():
    assert extract("<div class='page with-sidebar'><div class='sidebar'>s</div><article>text<div class='notice'>n</div><div class='article-header'>h</div></article></div>") == "text h"
    assert extract("<article>text</article><section class='comments'><article>first!</article></section><article class='comment'>me too</article>") == "text"
    assert extract("<header><h1>Site</h1></header><main><header><h1>Title</h1></header>body</main>") == "Title body"


RAW_CONTENT = ["for(i=0;i<n;i++){ // don't", 'x="<!--";', "a<b it's", 'if(a<b&&c>d){s="</p>"+\'<div class="ad">\'}', "<", "'", '"', "<!", "<b", "</", "<!-- <x '"]


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"])
@pytest.mark.parametrize("content", RAW_CONTENT)
def test_what_a_raw_element_holds_is_no_mark_up(tag, content):
    inside = f"<article><{tag}>{content}</{tag.upper()} ><p>Hello</p><p>Don't go</p><p>End</p></article><footer>f</footer>"
    assert extract(inside) == "Hello Don't go End"
    before = f"<head><{tag} x='>'>{content}</{tag}></head><body><p>b</p><nav>n</nav><footer>f</footer></body>"
    assert extract(before) == "b"
    assert extract(f"<p>a</p><{tag}>{content}") == "a"


def test_only_values_are_quoted_and_short_comments_end():
    assert extract("<p title=don't>a</p><p class=it's>b</p><footer>f</footer>") == "a b"
    assert extract("a<!-->b<!--->c<!-- > -->d") == "abcd"


@pytest.mark.parametrize("name", ["social-history", "related-work", "banner-story", "notice-of-terms", "share-price", "adsorption", "menu-planning-tips", "navigational-skills", "commentary"])
def test_a_part_of_a_name_says_nothing(name):
    for attribute in (f'id="{name}"', f'class="x {name}"'):
        assert extract(f"<article><p>a</p><section {attribute}><p>b</p></section></article>") == "a b"
        assert extract(f"<body><div {attribute}>b</div></body>") == "b"


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "site-footer", "cookie-notice", "mainNav", "comment_list", "left-sidebar", "related-posts", "newsletterBox"])
def test_a_whole_name_says_what_an_element_is(name):
    assert extract(f"<body><div class='{name}'>b</div><p>a</p></body>") == "a"
    assert extract(f"<article><p>a</p><div id='{name}'>b</div></article>") == "a"


MARK = [("<p>{}</p>", True), ("<b>{}</b><br>", True), ("<ul><li>{}</li></ul>", True), ("<section id='related-work'><p>{}</p></section>", True), ("<nav>{}</nav>", False), ("<div class='ad'>{}</div>", False), ("<script>{} < '\"<!--</script>", False), ("<style>/* {} it's a<b */</style>", False), ("<!-- {} -->", False), ("<form><p>{}</p></form>", False), ("<aside><div><p>{}</p></div></aside>", False), ("<section class='comments'><p>{}</p></section>", False)]


@pytest.mark.parametrize("seed", range(20))
def test_drawn_pages_give_the_texts_of_their_articles(spark, seed):
    """Pages put together from parts that are known to be text or not, read by the query's operator."""
    rng, rows, want = random.Random(seed), [], {}
    for i in range(5):
        said, page_ = [], ""
        for inside in (False, True, False):
            parts = [(*rng.choice(MARK), f"w{i} &amp; {rng.randrange(1000)}") for _ in range(rng.randrange(8))]
            page_ += ("<article>" if inside else "<div>") + "\n".join(m.format(w) for m, _, w in parts) + ("</article>" if inside else "</div>")
            said.append([w.replace("&amp;", "&") for _, is_text, w in parts if is_text])
        want[i] = " ".join(said[1] or said[0] + said[2])
        rows.append((i, f"http://h{i}.example/", f"<html><body>{page_}</body></html>"))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} if seed < 3 else {i: extract(h) for i, _, h in rows}
    assert got == want


def page(i):
    return f"<html><body><div class='x1'>Same on all pages</div><div class='x2'><p>Story {i} tells {i * i}.</p></div><div class='x3'>Call us</div></body></html>"


def test_a_site_s_repeated_branches_go(spark):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(50, "http://alone.example/", page(50)), (51, None, None), (52, "bad", "")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, n bigint, path string")
    got = {r.page_id: r for r in main_text(table).collect()}
    assert all(got[i].text == f"Story {i} tells {i * i}." for i in range(12))
    assert got[50].text == "Same on all pages Story 50 tells 2500. Call us"
    assert (got[51].text, got[51].n_chars, got[52].text) == ("", 0, "")
    assert main_text(table.where("page_id < 0")).count() == 0


def test_copies_of_one_page_stay(spark):
    rows = [(i, f"http://h.example/{i}", page(1)) for i in range(20)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in main_text(table).collect()} == {"Same on all pages Story 1 tells 1. Call us"}


def test_a_repeated_branch_goes_at_any_depth(spark):
    deep = lambda inner, n: "<div>" * n + inner + "</div>" * n
    rows = [(i, f"http://h.example/{i}", f"<html><body>{deep(f'<div class=q1>Same on all pages</div><div class=q2>Story {i} tells {i * i}.</div>', 15)}</body></html>") for i in range(12)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Story {i} tells {i * i}." for i in range(12)}


def plain_importances(pages, params):
    """{(host, path): importance} from the definition: pages are (host, {path: (above, shown, features)})."""
    out = {}
    for host in {h for h, _ in pages}:
        own = [p for h, p in pages if h == host]
        every = {k for p in own for k in p}
        count = {k: sum(k in p for p in own) for k in every}
        above = {k: next(p[k][0] for p in own if k in p) for k in every}

        def importance(key):
            held = [p[key] for p in own if key in p]
            m, shown = len(held), [x[1] for x in held]
            entropy = lambda values: -sum(v / sum(values) * math.log(v / sum(values), m) for v in values if v)  # noqa: E731, B023
            l = len(set(shown))
            names = {a for x in held for a in x[2]}
            content = 1 - sum(entropy([x[2][a] for x in held]) * sum(x[2][a] for x in held) for a in names) / sum(x[2].total() for x in held) if names else 0.0
            parts = [(sum(1 for x in held if x[2]), content)] + [(count[k], importance(k) if count[k] >= params.pages else 1.0) for k in every if above[k] == key]
            whole = sum(n for n, _ in parts)
            inner = sum(n * v for n, v in parts) / whole if whole else 0.0
            return (1 - params.damping**l) * entropy([shown.count(v) for v in set(shown)]) + params.damping**l * inner

        out |= {(host, k): importance(k) for k in every if count[k] >= params.pages}
    return out


def as_rows(pages):
    for host, page in pages:
        for path, (above, shown, features) in page.items():
            yield host, path, above, bool(features), shown, None
            yield from ((host, path, None, None, a, n) for a, n in features.items())


def test_importances_are_those_of_the_definition(spark):
    rng = random.Random(6)
    pages = []
    for _ in range(150):
        page, names = {}, [""]
        for k in range(rng.randrange(1, 14)):
            above = rng.choice(names[-2:])
            name = f"{above}/div:{rng.choice([0, 0, 0, 1, k])}"
            if name not in page:
                features = Counter({f"t{rng.choice([0, 0, 1, rng.randrange(40)])}": rng.randrange(1, 4) for _ in range(rng.randrange(4))})
                page[name] = (above, f"s{rng.choice([0, rng.randrange(4)])}", features)
                names.append(name)
        pages.append((f"h{rng.randrange(3)}", page))
    pages += [("one", {"div:1": ("", "same", Counter({"same": 1}))})] * 9 + [("few", {"div:1": ("", "s", Counter({f"t{i}": 1}))}) for i in range(7)]
    params = Params(pages=8)
    got = {(r.host, r.path): r.importance for r in importances(spark.createDataFrame(list(as_rows(pages)), "host string, path string, above string, own boolean, digest string, n bigint"), params).collect()}
    want = plain_importances(pages, params)
    assert got.keys() == want.keys() and ("one", "div:1") in got and ("few", "div:1") not in got
    assert max(p.count("/") for _, p in got) >= 3
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_varying_year_does_not_save_a_footer(spark):
    """Single features decide: a block that differs on every page leaves the blocks beside it as unimportant as they are."""
    rows = [(i, f"http://h.example/{i}", f"<body><div class=q1><p>All rights reserved</p><p>Imprint</p><p>Contact</p><p>Terms</p><p>Privacy</p><p>Jobs</p><p>Press</p><p>Help</p><p>About</p><p>Site map</p><p>Cookies</p><p>Seen {i}</p></div><div class=q2><p>Story {i}</p></div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Story {i}" for i in range(12)}


def test_a_host_with_several_templates_and_wordless_classes(spark):
    """Nothing in tags or classes says what is what; each template's fixed branches go, varying ones stay."""
    fixed = "<div class=k{t}><div class=a>Start | Help | Team {t}</div><div class=b><div>{body}</div></div><div class=c><ul><li>legal {t}</li><li>contact</li></ul></div></div>"
    rows = [(i, f"https://h.example/{i}?q", f"<body>{fixed.format(t=i % 3, body=f'<p>Story {i}</p>' * (1 + i % 4) + f'<ul><li>end {i}</li></ul>' * (i % 2))}</body>") for i in range(60)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in main_text(table).collect()}
    assert got == {i: " ".join([f"Story {i}"] * (1 + i % 4) + [f"end {i}"] * (i % 2)) for i in range(60)}
    assert sum(len(r.low) for r in style_tree(table.withColumn("host", host_of(table["url"]))).collect()) == 9


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a '" * 250_000, '<a "" ' * 160_000 + '">"', "<b>" * 90_000 + "</i>" * 90_000, "<p>" + "<a>" * 90_000 + "<br>" * 90_000, "<!--" * 250_000, "</div" * 200_000, "<script>" * 120_000])
def test_broken_mark_up_is_read_in_linear_time(page):
    began = time.process_time()
    extract(page)
    whole = time.process_time() - began
    began = time.process_time()
    extract(page[: len(page) // 8])
    assert whole < 1 or whole < 40 * (time.process_time() - began)


def test_deep_nesting_is_linear_and_digests_follow_the_text():
    deep = lambda word, n: "<div>x" * n + word + "</div>" * n
    began = time.process_time()
    assert len(nodes(deep("a", 40_000))) == 40_000
    assert time.process_time() - began < 20
    one, other, same = nodes(deep("a", 5)), nodes(deep("b", 5)), nodes(deep("a", 5))
    assert one == same and all(one[k][:2] == other[k][:2] for k in one)
    assert sum(one[k][2] != other[k][2] for k in one) == 1
    linked = nodes("<div><a href='/x'>y</a><img src=z></div>")
    assert sum(v.total() for *_, v in linked.values()) == 3
