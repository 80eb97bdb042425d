import random

from strataport.llm.html_extraction import extract, main_text

PARA = "The cat sat on the mat and it was not at all what they had said to her when we were there, but by then the rest of them had been out."


def test_article_without_its_surroundings():
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on the site and you can say no to them.</div><div class=ad>Buy the best of it.</div>
    <article><h1>A&nbsp;head &amp; more</h1><p>{PARA}<br>{PARA}<p>Short.</p><!-- no --><p><b>Un<i>closed</b> &#233;&eacute; <a href=x>link</a></p><form>Sign up <input></form></article>
    <section id="comments"><p>{PARA}</p></section><aside>{PARA}</aside><footer>&copy; me</footer></body>"""
    assert main_text(page).split("\n") == ["A head & more", f"{PARA} {PARA}", "Short.", "Unclosed éé link"]


def test_pages_without_an_article_go_by_density():
    links = "".join(f"<li><a href=/{i}>Some page of the site number {i}</a></li>" for i in range(9))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2><p>{PARA}</p><p>Yes.</p><p>{PARA}</p></div><div>© 2020</div>"
    text = main_text(page)
    assert PARA in text and "Yes." in text and "number 3" not in text


def test_what_follows_an_advert_is_judged_as_if_it_were_not_there():
    for ad in ('<div class="ad">Buy.</div>', '<div class="ad"><div><p>Buy.</div></div>', "<div class=share><section>Buy.</div>", "<aside>Buy.</aside>"):
        assert main_text(f"<article><p>{PARA}</p>{ad}<p>Short.</p></article>").split("\n") == [PARA, "Short."]
        assert main_text(f"<article>{ad}<p>One.</p><p>Two.</p><p>{PARA}</p></article>").split("\n") == ["One.", "Two.", PARA]
        assert main_text(f"<div><p>{PARA}</p>{ad}<p>Short.</p></div>").split("\n") == [PARA, "Short."]
    code = "x1 = y2 + z3; " * 7
    assert main_text(f'<article><p>{PARA}</p><div class="ad">Buy.</div><p>{code}</p></article>').split("\n") == [PARA, code.strip()]


def test_languages_without_stop_words_go_by_length_and_links():
    russian = "Кошка сидела на коврике, и всё было совсем не так, как они ей говорили, когда мы там были, но к тому времени остальные уже давно ушли домой, и никто не знал, когда они вернутся."
    japanese = "猫は敷物の上に座っていたが、それは私たちがそこにいたときに彼らが彼女に言ったこととはまったく違っていた。しかしその頃には残りの人々はもう家に帰っていて、いつ戻るのか誰も知らなかった。"
    polish = "Kot siedział na macie i wszystko było zupełnie inaczej, niż jej mówili, kiedy tam byliśmy, ale wtedy pozostali już dawno wyszli, więc nikt nie wiedział, kiedy wrócą z powrotem."
    for text in (russian, japanese, polish):
        links = "".join(f"<li><a href=/{i}>{text[:40]}</a></li>" for i in range(9))
        page = f"<body><div><ul>{links}</ul></div><div class=ad>{text}</div><div><h2>{text[:9]}</h2><p>{text}</p><p>{text[:20]}</p><p>{text}</p></div><footer>{text}</footer>"
        assert main_text(page).split("\n") == [text[:9].strip(), text, text[:20].strip(), text]
    assert main_text(f"<body><div><p>{PARA}</p><p>{russian}</p></div>").split("\n") == [PARA, russian]
    junk = "Widget alpha 12, gadget beta 99, gizmo gamma 7, " * 4
    assert main_text(f"<body><div><p>{PARA} {PARA}</p></div><div>{junk}</div>") == f"{PARA} {PARA}"


def test_names_that_say_something_else():
    code = "for (i = 0; i < n; i++) { total += price[i] * amount[i]; } return total / n;"
    terms = "The terms of this contract are as they were when it was made, and it can be said that they have not been of use to all of us."
    for page in (
        f'<div class="layout has-sidebar"><article><p>{PARA}</p></article><div class="sidebar"><p>{PARA}</p></div></div>', f'<div class="content-sidebar-wrap"><main><p>{PARA}</p></main></div>',
        f'<div id="page" class="widget-page"><p>{PARA}</p></div><div class="footer">{PARA[:50]}</div>', f'<article><p>{PARA}</p></article><div id="comments"><article><p>{PARA}</p></article></div>',
        f'<div id="comments"><article><p>{PARA}</p></article></div><article><p>{PARA}</p></article>', f'<article><p>{PARA}</p><div class="notice">Old.</div><div class="share-buttons"><p>{PARA}</p></div></article>',
    ):
        assert main_text(page) == PARA, page
    assert main_text(f'<article><div class="entry-header"><h1>Title</h1></div><p>{PARA}</p><section id="legal"><p>{terms}</p></section></article>').split("\n") == ["Title", PARA, terms]
    assert main_text(f"<article><p>{PARA}</p><pre>{code}</pre><p>{PARA}</p></article>").split("\n") == [PARA, code, PARA]
    assert main_text(f"<div><p>{PARA}</p><pre>{code}</pre><p>{PARA}</p></div>").split("\n") == [PARA, code, PARA]


def labelled():
    """Pages of several makes with their article's lines."""
    words = "the of and to in is it that was for on with as at by from had not but what all were when there can an each which do how if will up about out many then them these so some would make like into has look two more write go see number no way could people".split()
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice([*words, f"word{rng.randrange(500)}"]) for _ in range(n)).capitalize() + "."
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{say(rng.randrange(1, 5))}</a></li>' for i in range(rng.randrange(3, 12))) + "</ul>"
    frames = [
        "<article>{}</article>", '<main id="content">{}</main>', '<div class="content">{}</div>',
        '<div class="page with-sidebar"><article>{}</article></div>', '<div class="post-wrap"><div class="entry">{}</div></div>',
        "<table><tr><td>{}</td></tr></table>"
    ]
    junk = [
        lambda: f"<nav>{menu()}</nav>", lambda: f'<div class="sidebar">{menu()}</div>', lambda: f"<footer><p>{say(15)}</p></footer>",
        lambda: f'<div class="cookie-notice"><p>{say(25)}</p></div>', lambda: f'<div id="comments"><p>{say(60)}</p><p>{say(30)}</p></div>',
        lambda: f'<div class="ad-slot"><p>{say(12)}</p></div>', lambda: f"<form><label>{say(3)}</label><input></form>",
        lambda: f"<script>var x = '{say(9)}';</script>"
    ]
    for _ in range(120):
        lines = [say(5).rstrip(".")] + [say(rng.choice([6, 40, 60, 90])) for _ in range(rng.randrange(2, 7))] + [say(60)]
        body = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" + (rng.choice(junk[5:])() if rng.random() < 0.2 else "") for x in lines[1:])
        around = [rng.choice(junk)() for _ in range(6)]
        yield "<html><body>" + "".join(around[:3]) + rng.choice(frames).format(body) + "".join(around[3:]) + "</body></html>", lines


def test_precision_and_recall_on_labelled_pages():
    right = got = want = 0
    for page, lines in labelled():
        found = main_text(page).split("\n")
        right, got, want = right + len(set(found) & set(lines)), got + len(found), want + len(lines)
    assert right / got >= 0.98 and right / want >= 0.98, (right / got, right / want)


def test_very_long_pages():
    page = f"<article>{f'<p>{PARA}</p>' * 20_000}</article>" + "<div class=ad>" * 20_000
    assert main_text(page) == "\n".join([PARA] * 20_000)


def test_linked_headings_and_single_links_of_an_article():
    links = "".join(f"<li><a href=/{i}>Some page of the site number {i}</a></li>" for i in range(4))
    page = f"<article><h2><a href=/t>Title</a></h2><p>{PARA}</p><p><a href=/x>A source</a></p><p>{PARA}</p><ul>{links}</ul></article>"
    assert main_text(page).split("\n") == ["Title", PARA, "A source", PARA]
    assert main_text(f"<div><h2><a href=/t>Title</a></h2><p>{PARA}</p></div>") == PARA


def test_broken_markup():
    assert main_text(None) == "" and main_text("") == "" and main_text("<") == "" and main_text("<p class='x>") == ""
    assert main_text(f"<article><p>{PARA}<script>never closed {PARA}") == PARA
    assert main_text(f"<article><nav><p>{PARA}</p></article>") == PARA  # a menu that never ends isn't one
    assert PARA in main_text(f"<main>{'<div>' * 5000}<p>{PARA}</p>")
    assert main_text("İ" * 50 + f"<script>x</script><article><p>{PARA}</p></article>").endswith(PARA)


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{PARA}</p></article>"), (1, "u", f"<article><p>{PARA}</p></article>"), (None, None, None), (2, "v", "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", PARA, len(PARA))] * 2 + [(None, None, "", 0), (2, "v", "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
