"""Generated pages whose main text is known, and cases of left-out elements."""

import random
import time

import pytest

from allelix.llm import html_extraction as H

INLINE_OUT = ["<svg><text>no</text></svg>", "<svg/>", "<button>no <div>no</div></button>", "<select><option>no</select>", "<span hidden>no</span>", "<span class='share-buttons'>no</span>"]
BLOCK_OUT = [
    "<nav><ul><li>no<li><a href=x>no</a></ul></nav>", "<aside><p>no</aside>", "<div class='comment-list'><p>no</p><div>no</div></div>", "<div id=cookieBanner>no</div>", "<form><p>no</form>",
    "<div class='ad-slot ad-3'>no</div>", "<script>if (a<b) '</p>no'</script>", "<style>p{}</style>", "<!-- no <p>no -->", "<div role=search>no</div>", "<section class='related-posts'><h2>no</h2></section>",
]
KEPT = ["section-header", "social-history", "notice-period", "share-price", "no-sidebar", "header-less", "adlib", "relatedness"]


def page(rng):
    word = lambda: rng.choice("alpha beta gamma delta epsilon caf&eacute; a&amp;b x&lt;y".split())
    plain = lambda t: t.replace("&eacute;", "é").replace("&amp;", "&").replace("&lt;", "<")
    body, want = [], []
    for _ in range(rng.randint(1, 12)):
        if rng.random() < 0.3:
            body.append(rng.choice(BLOCK_OUT))
        parts, line = [], []
        for _ in range(rng.randint(1, 30)):
            w = word()
            line.append(plain(w))
            parts.append(rng.choice(["{}", "<b>{}</b>", "<i class=header-less>{}</i>"]).format(w))
            if rng.random() < 0.15:
                parts.append(rng.choice(INLINE_OUT))
        tag = rng.choice(["p", "h2", "blockquote", "li", f"p class={rng.choice(KEPT)}"])
        open_, shut = ("<ul><li>", "</li></ul>") if tag == "li" else (f"<{tag}>", rng.choice(["", "</p>"]) if tag == "p" else f"</{tag.split()[0]}>")
        body.append(open_ + rng.choice([" ", "\n  ", "<br>"]).join(parts) + shut)
        want.append(" ".join(line))
    inner = "\n".join(body)
    shell = rng.choice(["<article>{}</article>", "<main class='has-sidebar'>{}</main>", "<div id=content class='no-sidebar'>{}</div>", "<div class=widget><div class=text>{}</div></div>"])
    shut = rng.choice(["<footer><p>no</footer></body></html>", "<div class=footer>no</div>", ""])
    return "<!DOCTYPE html><html><head><title>no</title></head><body><header><h1>no</h1></header>" + BLOCK_OUT[0] + shell.format(inner) + shut, "\n".join(want)


def test_generated_pages(spark):
    rng = random.Random(1)
    made = [page(rng) for _ in range(300)]
    for p, want in made:
        assert H.main_text(p, []) == want, p
    rows = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(rows).collect()} == {i: want for i, (_, want) in enumerate(made)}


@pytest.mark.parametrize("inline", INLINE_OUT)
def test_inline_left_out_elements_do_not_end_the_line(inline):
    assert H.main_text(f"<body><p>The price {inline} rose fast</p><p>next {inline}</p></body>", []) == "The price rose fast\nnext"


def test_formulas_stay_and_links_count_for_nothing():
    assert H.main_text("<article><p>if <math><mi>a</mi></math> holds</article>", []) == "if a holds"
    links = "<div><p>" + "<a href=x>some link text</a> " * 50 + "</p></div>"
    best = max(H.scores(f"<body>{links}<section><p>short text</p></section></body>"), key=lambda x: x[1])[0]
    assert H.main_text(f"<body>{links}<section><p>short text</p></section></body>", [best]) == "short text"


def test_long_comments_go_and_a_wrapper_with_a_bad_name_stays():
    assert H.main_text(f"<body><div class=text><p>{'x ' * 20}</p><div class=comments><p>{'y ' * 900}</p></div></div></body>", []) == " ".join("x" * 20)
    assert H.main_text(f"<body><div class=toolbar><p>{'x ' * 200}</p><div class=comments>y</div></div></body>", []) == " ".join("x" * 200)


def test_deep_nesting_takes_linear_time_and_memory():
    took = []
    for n in (25_000, 100_000):
        at = time.process_time()
        assert H.main_text("<div>" * n + "deep" + "</div>" * n, []) == "deep"
        assert H.main_text("<div><p>a</section></b>" * n, []).count("a") == n
        took.append(time.process_time() - at)
    assert took[1] < 12 * took[0] + 1


def test_edges_of_the_table(spark):
    rows = [(1, "http://a.example/x", None), (1, "http://a.example/x", None), (2, None, "<p>t</p>"), (None, "", " "), (3, "http://A.example:80/", "<article><p>u</article>"), (4, "http://a.example/", "plain words")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, host long")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (1, "", 0), (2, "t", 1), (None, "", 0), (3, "u", 1), (4, "plain words", 11)], key=str)
    assert H.extract(df.limit(0)).collect() == []


def test_equal_votes_take_the_greatest_path(spark):
    a, b = "<section class=a><p>one one</p></section>", "<div class=b><p>two two</p></div>"
    rows = spark.createDataFrame([(1, "http://t.example/1", f"<body>{a}</body>"), (2, "http://t.example/2", f"<body>{b}</body>")], "page_id long, url string, html string")
    first = H.host_paths(rows.withColumn("host", H.host_of(rows.url)).select("host", "html")).collect()
    again = H.host_paths(rows.orderBy("page_id", ascending=False).withColumn("host", H.host_of(rows.url)).select("host", "html")).collect()
    assert first == again and len(first) == 1


LONG, SHORT = " ".join(["long"] * 120), " ".join(["short"] * 30)
ARTICLES = [
    # (markup with {0} for the long text and {1} for a short one, the blocks wanted)
    ("<article><h1>T</h1><p class=lead>L</p><div class=entry-content><p>{0}</p><p>{1}</p></div></article>", ["T", "L", LONG, SHORT]),
    ("<div class=post><div class=intro><p>{1}</p></div><div class=text><p>{0}</p></div><div class=outro><p>{1}</p></div></div>", [SHORT, LONG, SHORT]),
    ("<article><section class=a><h2>A</h2><p>{1}</p></section><section class=b><h2>B</h2><p>{0}</p></section><section class=c><p>{1}</p></section></article>", ["A", SHORT, "B", LONG, SHORT]),
    ("<article><header><h1>T</h1><p>L</p></header><div class=body><p>{0}</p></div><footer>no</footer></article>", ["T", "L", LONG]),
    ("<main><h1>T</h1><div class=a><p>{0}</p></div><aside>no</aside></main>", ["T", LONG]),
    ("<div class=story><h1>T</h1><div class=story-body><p>{0}</p><p>{1}</p></div></div>", ["T", LONG, SHORT]),
    ("<article><p>{0}</p><pre><code>x = 1 <span class='token comment'># why</span></code></pre></article>", [LONG, "x = 1 # why"]),
]
NOISE = [
    "<div class=comment-body><p>no no no</p></div>", "<div class=user-comments><p>no</p></div>", "<div class=post-comments><p>no</p></div>", "<article class=comment><p>no</p></article>",
    "<div class=google-ad>no</div>", "<div class='cookie-message'>no</div>", "<div id=articleComments>no</div>", "<ul class=links><li><a href=x>no</a><li><a href=y>no</a></ul>",
]


@pytest.mark.parametrize("markup, want", ARTICLES)
def test_titles_leads_and_sections_stay_and_comments_go(spark, markup, want):
    inner = markup.format(LONG, SHORT)
    pages = [f"<html><body><header>no</header><nav><a href=x>no</a></nav>{n}{inner}{n}<footer>no</footer></body></html>" for n in ["", *NOISE[:-1]]]
    shut = inner.rfind("</")
    pages += [f"<html><body>{inner[:shut]}{n}{inner[shut:]}</body></html>" for n in NOISE[:-1]]  # at the article's end
    pages.append(f"<html><body>{NOISE[-1]}{inner}</body></html>")
    for p in pages:
        assert H.main_text(p, []) == "\n".join(want), p
    rows = spark.createDataFrame([(i, "http://one.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(rows).collect()} == {"\n".join(want)}


def test_names_that_say_a_state_or_a_part_stay():
    for name in ("comments-open", "no-comments", "has-ads", "ad-free", "cookie-recipe", "ad-hoc", "entry-content"):
        assert H.main_text(f"<body><article><p>{LONG}</p><div class={name}><p>yes</p></div></article></body>", []) == f"{LONG}\nyes"
