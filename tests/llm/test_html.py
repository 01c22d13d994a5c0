import pytest

from ledgerloom.llm import html

SAY = "many words that make a paragraph of the article and go on for quite a while so that they count"
CASES = [
    ("", ""),
    ("no markup &amp; at all", "no markup & at all"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav><article><h1>Title &lt;1&gt;</h1><p>{SAY}<p>Be.</p><ul><li>one</li><li>two <b>bo</b>ld</li></ul></article><footer>c</footer></body>", f"Title <1>\n{SAY}\nBe.\none\ntwo bold"),
    (f"<body><div class='menu'><a href=x>a</a> <a href=y>b</a></div><div id=content><p>{SAY}</p><p>{SAY}<br>after  a\n break</p></div><div class='sidebar'>{SAY} {SAY}</div></body>", f"{SAY}\n{SAY} after a break"),
    (f"<article><p>{SAY}</p><aside>{SAY}</aside><div class=\"ad\">buy</div><form><input name=a>sub</form><p>last</p><section class='comments'><article><p>{SAY}</p></article></section></article>", f"{SAY}\nlast"),
    (f"<div><a>x</a><a>y</a><a>z</a></div><p>{SAY}</p><p>{SAY}</p><div><a>u</a><a>v</a><a>w</a></div>", f"{SAY}\n{SAY}"),
    (f"<main><p title='a > b'>{SAY}</p><!-- <p>no</p> --><script>if (a < b) '</p>'</script><p>&eacute;&#233;&#xe9; &nbsp;x</p></main>", f"{SAY}\néééx".replace("éééx", "ééé x")),
    (f"<article><p>{SAY} <b>open <i>both</p><p>next &amp", f"{SAY} open both\nnext &"),
    (f"<article><p>{SAY}</p><p a='", SAY),
    (f"<article><div class=cookie-notice>{SAY}</div></article>", ""),
    ("<p>" * 3000 + "deep" + "</p>" * 3000, None),
    ("<div class='x'>" * 5000 + SAY, SAY),
    ("<a '" * 2000, ""),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_main_text(page, want):
    got = html.main_text(page, {})
    assert want is None or got == want


def test_weights_are_learned_from_pages_that_label_themselves(spark):
    page = f"<body><div class='zq-top'>{SAY}</div><div class='wrap'><article><p class='lede'>{SAY}</p></article></div></body>"
    plain = f"<body><div class='zq-top'>{SAY} {SAY} {SAY}</div><p class='lede'>{SAY}</p></body>"
    rows = [(i, page, "t") for i in range(20)] + [(100, plain, "t"), (101, None, "t"), (102, "", "t"), (102, plain, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    learned = html.fit_weights(df, "page_id", "html")
    assert learned[".zq-top"] < -2 and learned[".lede"] > 2
    got = sorted((r["page_id"], r["text"]) for r in html.extract(df, learned).where("page_id >= 100").collect())
    assert got == [(100, SAY), (101, ""), (102, ""), (102, SAY)]
    none = df.where("page_id < 0")
    assert html.fit_weights(none, "page_id", "html") == {} and html.extract(none, {}).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 600 + f"<nav>{SAY}</nav><article><div>{SAY}</div><p>{SAY}</p></article>",
        f"<div class=post>" + "<p class=x>a" * 600 + f"<aside>{SAY} no</aside></div>",
        f"<article><p>{SAY}</p><ul class=menu><li>x<ul><li>y</li></ul></li><li>no {SAY}</li></ul></article>",
        f"<article><p>{SAY}</p><span class=ad>x<span>y</span> no</span></article>",
    ],
)
def test_open_elements_are_all_known(page):
    got = html.main_text(page, {})
    if page.startswith("<div>"):
        assert got == f"{SAY}\n{SAY}"
    else:
        assert " no" not in got and "no " not in got and len(got) > 90


@pytest.mark.parametrize("name", ["svg-icon", "button-group", "title-bar", "select-box", "style-guide"])
def test_longer_names_are_no_hidden_elements(name):
    assert html.main_text(f"<body><{name}></{name}><p>{SAY}</p></body>", {}) == SAY


def test_hidden_elements_end_with_their_parent():
    assert html.main_text(f"<div><button>push me</div><p>{SAY}</p><div><svg><text>no</svg></div>", {}) == SAY
    assert html.main_text(f"<div class='related-work'><p>{SAY}</p></div>", {}) == SAY


def test_best_run_against_brute_force():
    import random

    r = random.Random(7)
    for _ in range(400):
        x = [r.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(r.randrange(0, 12))]
        sums = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        i, j = html.best_run(x)
        assert sum(x[i:j]) == max([0, *sums.values()])


def test_the_score_of_a_tag_is_learned(spark):
    page = "<body>" + "<div><a href=x>link</a></div>" * 20 + f"<article><p>{SAY}</p><p>{SAY}</p></article></body>"
    df = spark.createDataFrame([(i, page) for i in range(10)], "page_id long, html string")
    weights = html.fit_weights(df, "page_id", "html")
    assert -8 <= weights[html.TAG] < 0


@pytest.mark.parametrize("name", ["social-history", "related-research", "share-price", "notice-of-meeting", "search-engines-explained", "popup-restaurants", "comment"])
def test_an_article_under_a_name_like_a_menus_is_found(name):
    long = " ".join(SAY for _ in range(12))
    page = f"<body><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul><div class='{name}'><p>{long}</p><p>{SAY}</p></div><p>short next</p></body>"
    for weights in ({}, {html.TAG: -2.5}):
        got = html.main_text(page, weights)
        assert got.startswith(f"{long}\n{SAY}") and "Home" not in got


@pytest.mark.parametrize("name", ["ad", "ad-slot-2", "share-buttons", "related-posts", "cookie-notice", "comment-list", "site-footer", "user-login", "header__title"])
def test_names_of_such_words_alone_rule_out(name):
    long = " ".join(SAY for _ in range(3))
    assert html.main_text(f"<body><div class='{name}'><p>{long} no</p></div><p>{SAY}</p></body>", {}) == SAY
    assert html.main_text(f"<article><p>{SAY}</p><div class='{name}'>no</div></article>", {}) == SAY


def test_doubt_halves_a_score_and_the_run_decides():
    long = " ".join(SAY for _ in range(3))
    links = "".join(f"<a href={i}>l</a>" for i in range(30))
    page = lambda a, b: f"<div class='social-history'><p>{a}</p></div>{links}<div class='x'><p>{b}</p></div>"
    assert html.main_text(page(f"{SAY} a", SAY), {}) == SAY
    assert html.main_text(page(long, SAY), {}) == long
    assert html.main_text(f"<div class='x'><p>{SAY} a</p></div>{links}<div><p>{SAY}</p></div>", {}) == f"{SAY} a"


def test_the_run_decides_where_no_mark_does():
    links = "".join(f"<li><a href={i}>link {i} here</a></li>" for i in range(30))
    page = f"<ul>{links}</ul><p>{SAY}</p><p>{SAY}</p><ul>{links}</ul>"
    assert html.main_text(page, {html.TAG: -2.0}) == f"{SAY}\n{SAY}"
    assert "link" in html.main_text(page, {html.TAG: 0.0})
