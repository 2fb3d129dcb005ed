"""Extraction on pages written by hand, apart from the templates that the model is trained on."""

import random

import pytest

from tessera.llm import html_text

WANT = ["The long road to the sea", "It was a bright cold day in April, and the clocks were striking thirteen over the town.", "Nobody had expected the ships to come home so early in the year, least of all the harbour master."]
PRIVACY = "We value your privacy and use small files to make this page better for you."


def article(more=""):
    return f"<article><h1>{WANT[0]}</h1><p>{WANT[1]}</p><p>{WANT[2]}</p>{more}</article>"


BARE = f"<h1>{WANT[0]}</h1><p>{WANT[1]}</p><p>{WANT[2]}</p>"
CASES = {
    "cookie banner": (f"<div class='cookie-banner'><p>{PRIVACY}</p></div>{article()}", WANT),
    "form in the article": (article("<form action='/n'><p>Get our letter every week, straight to your inbox.</p><input type=email><button>Go</button></form>"), WANT),
    "disqus": (f"{article()}<div id='disqus_thread'><div class='post'><p>I totally disagree with this piece, the ships were late.</p></div></div>", WANT),
    "reader comments": (f"{article()}<section class='reader-comments'><div class='body'><p>Lovely writing, thank you so much for it.</p></div></section>", WANT),
    "comments in the article": (article("<section class='reader-comments'><div class='body'><p>Lovely writing, thank you so much for it.</p></div></section>"), WANT),
    "advert in another language": (article("<div class='werbung'><p>Kaufen Sie jetzt unsere neuen Schuhe zum halben Preis.</p></div>"), WANT),
    "another advert": (f"<div id='publicite'>Achetez nos chaussures à moitié prix aujourd'hui.</div>{article()}", WANT),
    "contentinfo": (f"{article()}<div role='contentinfo'><p>All rights reserved by the harbour press and its partners.</p></div>", WANT),
    "layout table": (f"<table><tr><td width=150><a href=/a>Home</a><br><a href=/b>News</a></td><td>{BARE}</td></tr></table>", WANT),
    "layout table and article": (f"<table><tr><td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>Sport</a></td><td>{article()}</td><td class='lateral'>Sunny today</td></tr></table>", WANT),
    "hidden": (article("<p hidden>This text is never shown to any of the readers.</p><div style='display:none'>Neither is this one, which is hidden too.</div>"), WANT),
    "comments only": ("<nav><ul><li><a href=/>Home</a></li></ul></nav><div id='comments'><div class='comment'><p>First! This is the best page that I have ever seen.</p></div><div class='comment'><p>I don't agree with you at all, my friend.</p></div></div>", []),
    "short list": (article("<ul><li>Eggs</li><li>Milk</li><li>Flour</li></ul>"), [*WANT, "Eggs", "Milk", "Flour"]),
    "paragraph of one link": (article("<p><a href='/more'>The whole story of the harbour in pictures</a></p>"), [*WANT, "The whole story of the harbour in pictures"]),
    "names around the page": (f"<div id='page' class='site with-sidebar'>{article()}</div><div class='sidebar'><p>Follow us for more.</p></div>", WANT),
    "no article element": (f"<div class='topbar'><a href=/>Home</a></div><div id='content'>{BARE}</div><div id='kommentare'><p class='text'>Sehr schön geschrieben, vielen Dank dafür.</p></div>", WANT),
    "pages": (f"{article()}<div class='pagination'><a href=1>1</a> <a href=2>2</a> <a href=3>next</a></div>", WANT),
    "aside in the article": (article("<aside><p>Related: how the tide was won in the winter of that year.</p></aside>"), WANT),
    "short article": ("<nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav><article><p>Short.</p></article><footer>&copy; us</footer>", ["Short."]),
    "joined names": (f"{article()}<div class='commentlistitem'><p>This is what I think of it all, dear readers.</p></div>", WANT),
}


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.labelled_pages())


@pytest.mark.parametrize("name", CASES)
def test_pages_of_other_makes(model, name):
    page, want = CASES[name]
    assert model.extract(f"<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar comments-open'>{page}</body></html>") == want


def test_layouts_with_other_names(model):
    """Pages put together from other layouts, names and words than the templates': shares of characters."""
    r = random.Random(20)
    words = "harbour ship captain winter market stone river letter window bread night road summer garden".split()
    good = bad = miss = 0
    for _ in range(150):
        want = []

        def say(lo=6, hi=25, keep=True):
            t = " ".join(r.choice(words) for _ in range(r.randint(lo, hi))).capitalize() + f" {r.randrange(10**6)}" + r.choice([".", ".", "!", ""])
            if keep:
                want.append(t)
            return t

        links = lambda n: "".join(f"<li class=item><a href=/{i}>{r.choice(words)}</a></li>" for i in range(n))
        body = "".join(r.choice([f"<p>{say()}</p>", f"<p class=lead>{say()}</p>", f"<h2>{say(2, 5)}</h2>", f"<ul><li>{say(1, 3)}</li><li>{say(1, 3)}</li></ul>", f"<div class=par>{say()}</div>", f"<blockquote><p>{say()}</p></blockquote>"]) for _ in range(r.randint(3, 9)))
        if r.random() < 0.4:
            body += r.choice([f"<div class='ad-slot-3'><span>{say(keep=False)}</span></div>", f"<div class='newsletter-box'><p>{say(keep=False)}</p></div>", f"<figure class='promo'><p>{say(keep=False)}</p></figure>"])
        main = r.choice([f"<main id=hauptinhalt>{body}</main>", f"<div class='entry-content clearfix'>{body}</div>", f"<section role=main><div class=wrapper>{body}</div></section>", f"<article id=a7 class='beitrag'>{body}</article>"])
        top = r.choice([f"<header id=top><ul>{links(5)}</ul><p>{say(3, 6, False)}</p></header>", f"<div class='nav-bar'><ul>{links(7)}</ul></div>", f"<div id=kopfzeile><b>{say(2, 4, False)}</b></div>"])
        side = r.choice(["", f"<div class='sidebar-right'><h4>{say(1, 2, False)}</h4><ul>{links(6)}</ul></div>", f"<aside><p>{say(keep=False)}</p></aside>", f"<div class='gdpr-consent'><p>{say(keep=False)}</p><button>ok</button></div>"])
        end = r.choice([f"<footer><p>{say(keep=False)}</p></footer>", f"<div id=impressum>{say(keep=False)}</div>", f"<div class='comments-area'><ol><li><div class=text><p>{say(keep=False)}</p></div></li></ol></div><footer>&copy; {say(2, 3, False)}</footer>"])
        page = f"<html><body>{top}{main}{side}{end}</body></html>"
        want = [t for t in want if t in page]
        got = model.extract(page)
        good += sum(len(t) for t in got if t in want)
        bad += sum(len(t) for t in got if t not in want)
        miss += sum(len(t) for t in want if t not in got)
    assert good / (good + bad) > 0.95 and good / (good + miss) > 0.95
