import time

import pytest

from newsloom.llm.html_text import extract, main_text

PROSE = "The cat sat on the mat and it was the best of the days for all of them. " * 4


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<nav>", ""), ("plain text", "plain text"), ("<p>a<b>b</b>c&nbsp;d &am &amp;amp; &#233;", "abc d &am &amp; é"),
        ("<article><p>Hi <span class='ad'>buy</span> there<script>x</script> you</p></article>", "Hi there you"),
        ("<header><h1>Site</h1></header><main><h1>T</h1><p>x<br>y<!-- no --></main><footer>f</footer>", "T x y"),
        (f"<div>Home | About</div><p>{PROSE}</p><p>Short end.</p><div class='cookie-notice'>We use cookies.</div>", f"{PROSE}Short end."),
        (f"<article><p>{PROSE}</p><section id=comments><article><p>{PROSE}</p></article></section></article>", PROSE.strip()),
        ("<article>one<form>name <input> send</form><aside>also</aside><p>two<ul><li><a href=x>more</a></ul></article>", "one two"),
        ("<p title='a > b'>x < y</p>", "x < y"),
        (f"<ul><li><a href=x>a</a><li><a href=y>b</a></ul><p>{PROSE}<p>{PROSE}", f"{PROSE}{PROSE.strip()}"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body><article><p>{PROSE}</p></article>",
        f"<html><head><title>x</title><script>y</script><meta name=a content=b><p>{PROSE}",
        f"<html><head><title>x</title></head><body><p>{PROSE}</p></body></html>",
        f"<p><svg class='icon' viewBox=\"0 0 1 1\"/>{PROSE}</p>",
        f"<p><svg><path d=x /></svg>{PROSE}<math/></p>",
    ],
)
def test_open_heads_and_empty_pictures_swallow_nothing(page):
    assert main_text(page) == PROSE.strip()


@pytest.mark.parametrize(
    "page",
    [
        f"<script data-props=\"{'a > b ' * 400}\">var code</script><p>{PROSE}",
        f"<svg style='{'x' * 1001}'><text>drawn</text></svg><p>{PROSE}",
        f"<iframe srcdoc=\"{'<p>inner</p>' * 200}\">none</iframe><p>{PROSE}",
        f"<p data-caption=\"{'<b>seen</b> ' * 200}\">{PROSE}",
        f"<p {' '.join(f'a{i}=v{i}' for i in range(300))} b='x > y'>{PROSE}",
        f"<script {' '.join(f'a{i}={chr(34)}v{chr(34)}' for i in range(300))}>var code</script><p>{PROSE}",
        f"<p title=it's>{PROSE}",
        f"<p><svg width=10/>drawn</svg>{PROSE}",
        f"<p><select-box>{PROSE}</select-box>",
    ],
)
def test_tags_of_any_length(page):
    assert main_text(page) == PROSE.strip()


BODY = f"<div><p>{PROSE}</p><p>{PROSE}</p></div>"
WEAK = "The cat sat on the mat and it was the best of the days for all of them in a week. "


@pytest.mark.parametrize(
    "page, text",
    [
        (f"{BODY}<article><p>Teaser of another story.</p></article>", f"{PROSE}{PROSE}Teaser of another story."),  # short: as its neighbour
        (f"{BODY}<article><h2>Other</h2><p>{WEAK}</p></article>", f"{PROSE}{PROSE}Other"),
        (f"{BODY}<article><p><a href=x>Teaser of another story.</a></p></article>", f"{PROSE}{PROSE.strip()}"),
        (f"{BODY}<nav>Home</nav><aside>x</aside><div class=post><a href=x>Teaser</a></div>", f"{PROSE}{PROSE.strip()}"),
        (f"<div class=content>{BODY}</div><article><a href=x>Teaser</a></article><nav>n</nav><p>Short.</p>", f"{PROSE}{PROSE.strip()}"),
        (f"<p>{WEAK}</p><p>{WEAK}</p><article>Teaser</article>", f"{WEAK}{WEAK}Teaser"),
        (f"<p>{PROSE}</p><article>{BODY}</article>", f"{PROSE}{PROSE.strip()}"),
        ("<p>Lead</p><article><p>Short text.</p></article>", "Short text."),
    ],
)
def test_an_article_is_a_prior(page, text):
    assert main_text(page) == text


def test_hostile_values_are_read_once():
    start = time.time()
    for piece in ('<a b="', "<a b='\"<a b=\"'", "<a b=\"'<a c='\" ", "<a =x='\"<b ='", "<svg a='>", "</script <script x", "<a b= ", "<a b='' ", "=<a "):
        for page in (piece * 30_000, piece * 30_000 + "<", "<a b=\"" + piece * 30_000, "<script>" + piece * 30_000):
            main_text(page)
    assert time.time() - start < 40


def test_hostile_markup_is_read_once():
    start = time.time()
    for page in ("<p " * 50_000, '<a "' * 50_000, "<div>" * 5_000, "<!--" * 50_000, "<script>" * 50_000, "<" * 100_000):
        main_text(page)
    assert time.time() - start < 20


def test_table(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(1, None, "<p>é", "", ""), (1, None, "<p>é", "", ""), (None, "u", None, "", "")], schema)
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract(df).collect()) == [("1", "é", 1), ("1", "é", 1), ("None", "", 0)]
    assert extract(df.limit(0)).count() == 0


LONG = "This is the kind of prose that people write when they have something to say about the world and the things in it. " * 4


def test_names_do_not_lose_the_only_article():
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
    want = " ".join(f"{LONG}{i}" for i in range(4))
    for around in ('<div class="widget-post">', '<div class="page social-article">', '<div id="page-with-sidebar">', '<div class="with-sidebar"><div class="no-comments">'):
        assert main_text(f"<html><body>{around}{body}</div></body></html>") == want
    # What is named inside a wrapper, or beside good text, still goes.
    side = f'<div class="sidebar"><p>{LONG} side</p></div>'
    assert main_text(f'<body><div id="page-with-sidebar">{body}{side}</div></body>') == want
    assert main_text(f"<body>{body}{side}</body>") == want
    assert LONG.strip() in main_text(f'<article><h1>A title</h1><div class="share-wrap related"><p>{LONG}</p></div></article>')


def test_a_page_in_a_language_without_stop_words():
    text = "Это довольно длинный абзац, который написан на языке, слов которого нет ни в одном из списков. " * 4
    page = f'<body><ul><li><a href="/">Главная</a></li><li><a href="/x">Новости</a></li></ul><p>{text}</p><p>{text}2</p></body>'
    assert main_text(page) == f"{text.strip()} {text}2"


def test_end_tags_without_a_start_are_linear():
    import time

    start = time.perf_counter()
    for page in ("<b></i>" * 150_000, "<b>" * 100_000 + "<div></div>" * 50_000):
        assert main_text(page) == ""
    assert time.perf_counter() - start < 30
