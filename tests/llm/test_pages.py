"""Pages written by hand in layouts of common site kinds, with the text that a reader would call the article."""

import time

import numpy as np
import pytest

from lumenframe.llm import html

P = [
    "The old harbour was built in three stages, and the first of them took nearly forty years to complete.",
    "Most of the stone came by boat from quarries further up the coast, where the rock was softer and easier to cut.",
    "Visitors can walk along the outer wall in summer, although the lower path is closed when the wind is strong.",
    "In the winter of that year a storm broke the eastern arm, and the town had to borrow money for the repairs.",
    "Today the harbour serves a small fishing fleet, two ferries and a growing number of sailing boats.",
]
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About us</a></li><li><a href='/contact'>Contact</a></li></ul>"


def page(body, title="The old harbour"):
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title><style>p{{color:red}}</style><script>var a = '<p>no</p>';</script></head><body>{body}</body></html>"


PAGES = {
    "news": (page(f"<header><div class='logo'><a href='/'>Coast Daily</a></div><nav>{MENU}</nav></header><main><article><h1>Harbour reopens</h1><p>{P[0]}</p><figure><img src='a.jpg'><figcaption>The eastern arm in spring.</figcaption></figure><p>{P[1]}</p><h2>What comes next</h2><p>{P[2]}</p></article></main><aside class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>Ferry timetable changes</a></li><li><a href='/2'>New school opens</a></li></ul></aside><footer><p>&copy; 2024 Coast Daily. All rights reserved.</p></footer>"), ["Harbour reopens", P[0], "The eastern arm in spring.", P[1], "What comes next", P[2]]),
    "wiki": (page(f"<div id='content' class='body'><h1 id='firstHeading'>Old harbour</h1><div id='bodyContent'><div id='content-text' class='parser-output'><p>{P[0]}</p><p>{P[1]} See the <a href='/q'>quarry</a> article.</p><h2>Use</h2><p>{P[4]}</p><ul><li>Two ferries cross the bay every day in summer.</li><li>Fishing boats land their catch at dawn.</li></ul></div></div></div><div id='navigation'><h3>Navigation</h3>{MENU}</div><div id='footer'>This page was last edited on 3 May. Privacy policy | About</div>"), ["Old harbour", P[0], f"{P[1]} See the quarry article.", "Use", P[4], "Two ferries cross the bay every day in summer.", "Fishing boats land their catch at dawn."]),
    "blog": (page(f"<div id='header'><h1><a href='/'>Notes from the coast</a></h1><p>a weblog</p></div><div id='main'><div class='post'><h2 class='post-title'>Walking the wall</h2><div class='post-body'>{P[2]}<br><br>{P[3]}<br><br>{P[4]}</div></div><div id='comments'><h4>2 comments</h4><div class='comment'><b>Ann</b> says: <p>Thanks, great post!</p></div><div class='comment'><b>Guest</b> says: <p>I agree with Ann.</p></div></div></div><div id='footer'>Powered by notes</div>"), ["Walking the wall", f"{P[2]} {P[3]} {P[4]}"]),
    "table": (page(f"<table width='100%'><tr><td colspan='2'><a href='/'>Home</a> <a href='/news'>News</a> <a href='/contact'>Contact</a></td></tr><tr><td class='menu'>{MENU}</td><td><h1>The harbour</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[3]}</p></td></tr><tr><td colspan='2'>Copyright 2004, all rights reserved</td></tr></table>"), ["The harbour", P[0], P[1], P[3]]),
    "forum": (page(f"<div class='breadcrumb'><a href='/'>Forum</a> &gt; <a href='/b'>Boats</a></div><div class='topic'><h1>How was the wall built?</h1><div class='post'><p>{P[0]} {P[1]}</p><p>{P[3]}</p></div></div><div class='replies'><div class='reply'><p>Good question, I would like to know too.</p></div><div class='reply'><p>Ask in the museum.</p></div></div><form class='reply-form'><label>Your message</label><textarea></textarea><button>Submit</button></form>"), ["How was the wall built?", f"{P[0]} {P[1]}", P[3]]),
    "shop": (page(f"<div class='topbar'>{MENU}</div><div class='product'><h1>Harbour model kit</h1><div class='product-description'><p>{P[1]}</p><p>{P[4]}</p><ul><li>Cut from oak, ready to paint.</li><li>Ships with a printed guide of forty pages.</li></ul></div></div><div class='related'><h3>You may also like</h3><ul><li><a href='/a'>Lighthouse kit</a></li><li><a href='/b'>Ferry kit</a></li></ul></div><div class='newsletter'><p>Subscribe to our newsletter</p><input><button>Sign up</button></div><footer>&copy; Kits and more</footer>"), ["Harbour model kit", P[1], P[4], "Cut from oak, ready to paint.", "Ships with a printed guide of forty pages."]),
    "manual": (page(f"<div class='layout'><div class='sidebar'><ul class='toc'><li><a href='#a'>Install</a></li><li><a href='#b'>Configure</a></li><li><a href='#c'>Run</a></li></ul></div><div class='content'><h1>Install the pump</h1><p>{P[2]}</p><pre><code>pump --start --level 3</code></pre><p>{P[3]}</p><ol><li>Open the valve slowly.</li><li>Wait until the gauge stands still.</li></ol></div></div><div class='footer'>Previous | Next</div>"), ["Install the pump", P[2], "pump --start --level 3", P[3], "Open the valve slowly.", "Wait until the gauge stands still."]),
    "bare": (page(f"<h1>The harbour</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p><p>{P[4]}</p>"), ["The harbour", P[0], P[1], P[2], P[4]]),
    "wrapped": (page(f"<div id='app'><div class='page'><div class='site-header'><span>Coast</span>{MENU}</div><div class='container'><div class='row'><div class='col'><div class='entry-content'><h1>Storm damage</h1><p>{P[3]}</p><blockquote><p>{P[2]}</p></blockquote><p>{P[4]}</p></div></div><div class='col widget'><p>Advertisement: buy now, free shipping</p></div></div></div><div class='colophon'>Terms of use</div></div></div>"), ["Storm damage", P[3], P[2], P[4]]),
    "cookie": (page(f"<div class='cookie-notice'><p>We use cookies to improve your experience. Accept all or reject.</p><button>Accept</button></div><nav>{MENU}</nav><main><h1>Boats</h1><p>{P[4]}</p><p>{P[0]}</p></main><section class='comments'><h3>Comments</h3><p>Posted by a guest: thanks for this.</p></section><footer>Imprint</footer>"), ["Boats", P[4], P[0]]),
    "sloppy": (page(f"<nav><a href=/>Home</a> <a href=/n>News</a></nav><div class=content><h2>Quarries<p>{P[1]}<p>{P[2]}<ul><li>Soft rock<li>Hard rock, used for the outer wall</ul><p>{P[3]}</div><div class=footer>&copy; all rights reserved"), ["Quarries", P[1], P[2], "Soft rock", "Hard rock, used for the outer wall", P[3]]),
    "two": (page(f"<div class='masthead'><h1>Harbour society</h1>{MENU}</div><section class='main-content'><h2>Annual report</h2><p>{P[0]}</p><p>{P[3]}</p><table><tr><th>Year</th><td>Ships</td></tr><tr><th>1990</th><td>212 vessels</td></tr></table><p>{P[4]}</p></section><div class='ad'>Sale! Click here for the best deal</div><div class='bottom'>Contact | Sitemap</div>"), ["Annual report", P[0], P[3], "Year", "Ships", "1990", "212 vessels", P[4]]),
}


@pytest.fixture(scope="module")
def net():
    return html.trained()


def test_articles_of_common_layouts(net):
    """Nine in ten of the blocks that belong to the articles come out, one in ten of what comes out may be something else; every article is found."""
    right = wanted = given = 0
    for name, (text, blocks) in PAGES.items():
        got = html.main_texts([text], net)[0].split("\n\n")
        hit = len(set(got) & set(blocks))
        assert hit >= len(set(blocks)) / 2, (name, got)
        right, wanted, given = right + hit, wanted + len(set(blocks)), given + len(set(got) - {""})
    assert right >= 0.9 * wanted and right >= 0.9 * given, (right, wanted, given)


def test_deep_nesting_costs_its_length():
    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        found = html.blocks("<div class='a b'>x" * n)
        took.append(time.perf_counter() - began)
        assert len(found) == n and max(len(p) for _, p, _ in found) <= html.PATH
    assert took[1] < 40 * max(took[0], 0.01)
    began = time.perf_counter()
    assert len(html.blocks("<div>" * 500 + "<b>" + "<i>" * 5000 + "x</b></p>" * 5000)) > 0
    assert time.perf_counter() - began < 30


def test_long_pages_are_read_in_pieces(net):
    found = html.blocks(PAGES["news"][0]) + [("word " * (k % 7 + 1), ("html", "body", "p"), 0) for k in range(3000)]
    x = html.features(found)[:, None, :]
    whole = net.forward(x, np.ones((len(found), 1), bool), False)[0][:, 0]
    assert np.allclose(whole, net.long(found, 256), atol=1e-4)
    assert np.allclose(html.features(found)[700:900], html.features(found[700:900], 700, len(found)))
    many = [("w", ("p",), 0)] * 60000
    assert len(net.label([many, found])[0]) == 60000
