"""Labelled pages, written by hand: what stands in an element with data-main is main text."""

from __future__ import annotations

_LONG = "The council met on Tuesday to hear what residents think of the new bridge, and most of those who spoke were in favour of a crossing for walkers and bicycles alone."
_MORE = "A second reading is planned for the autumn, after the engineers have measured how far the river's banks have moved since the last survey was made."
_MID = "Nobody had expected so many people to come that evening."
_SHORT, _TINY = "Few agreed.", "Yes."

#: Articles between menus, adverts and footers, as most pages are built.
_NEWS = [
    f'<html><head><title>Bridge</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport and games</a></li></ul></nav><div class="ad">Cheap flights to the islands this week only.</div>'
    f"<article data-main><h1>Bridge</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p><p>{_TINY}</p></article><footer>&copy; The Paper. All rights are reserved.</footer></body></html>",
    f'<body><header><h1>Daily Paper</h1><p>The news of the day since 1890</p></header><main data-main><h2>Short notice</h2><p>{_TINY}</p><p><a href="/x">{_SHORT}</a></p><p>{_MID}</p></main>'
    f'<aside><h3>Read next</h3><p>{_LONG}</p><p><a href="/y">{_MID}</a></p></aside><footer><p>Imprint</p><p>{_MID} Write to the editors at any time of the day.</p></footer></body>',
    f'<body><div id="cookie-notice">We use cookies to make this page better for you and for our partners. <a href="/c">More</a></div><div class="content"><div data-main><p>{_MID}</p><ul><li>{_TINY}</li><li>{_SHORT}</li></ul><p>{_LONG}</p></div>'
    f'<section class="comments"><h3>Comments</h3><p>{_LONG}</p><p>{_SHORT}</p></section></div><form><p>Your mail address</p><p>{_MID}</p></form></body>',
    f'<body><div class="sidebar"><p>{_MID}</p><p>{_LONG}</p></div><article><header data-main><h1>{_MID}</h1></header><div data-main><p>{_TINY}</p><p>{_SHORT}</p></div><div class="share"><a href="/t">Share this</a></div></article>'
    f'<div class="related"><h4>Related</h4><p>{_MORE}</p></div><div class="newsletter"><p>{_LONG}</p></div></body>',
    f'<body><article data-main><p>{_SHORT}</p></article><article data-main><h2>{_SHORT}</h2><p>{_MID}</p><blockquote>{_MORE}</blockquote><table><tr><td>12</td><td>{_TINY}</td></tr></table></article><footer>{_LONG}</footer></body>',
    f'<body><div class="banner"><p>{_SHORT}</p></div><nav><a href="/a">{_MID}</a></nav><article data-main><p><a href="/l">{_MID}</a></p><p><a href="/l">One</a></p><p>{_TINY}</p></article><div class="comments"><p>{_TINY}</p><p>{_MID}</p></div></body>',
]
#: Pages with little else than one place.
_ALONE = [
    f"<article data-main><p>{_TINY}</p></article>", f"<article data-main><p>{_MID}</p></article>", f"<main data-main><p>{_LONG}</p></main>", f'<article data-main><a href="/o">{_SHORT}</a></article>',
    f"<article data-main><h1>{_SHORT}</h1><p>{_TINY}</p></article>", f"<nav><p>{_MID}</p></nav>", f"<footer><p>{_LONG}</p></footer>", f'<div class="ad">{_SHORT}</div>', f"<aside><p>{_TINY}</p><p>{_MORE}</p></aside>",
    f'<nav><a href="/">Home</a></nav><article data-main>{_SHORT}</article>', f"<article data-main>{_TINY}</article><footer>{_LONG}</footer>",
]
#: Pages whose markup says nothing of places: there, words and links decide.
_PLAIN = [
    f'<body><table><tr><td><a href="/">Home</a></td><td><a href="/n">News</a></td></tr></table><div data-main><p>{_LONG}</p><p>{_MORE}</p></div><p><a href="/i">Imprint</a> <a href="/p">Privacy</a></p></body>',
    f'<body><p><a href="/a">One</a> <a href="/b">Two</a> <a href="/c">Three</a></p><div data-main><h1>{_SHORT}</h1><p>{_LONG} {_MORE}</p><p>{_LONG}</p><p>{_MID}</p><p>{_MORE} {_MORE}</p></div><p>2024</p></body>',
    f'<body><div><div>Menu</div><div><a href="/">Start</a></div><div><a href="/x">About us</a></div></div><div data-main><div>{_MORE}</div><div>{_LONG} <a href="/z">source</a></div><div>{_LONG}</div></div><div><a href="/q">Next page</a></div><div>Terms</div></body>',
    f'<p data-none><a href="/1">First</a></p><div data-main><p>{_MORE} {_LONG}</p><p>{_MORE}</p></div><p><a href="/2">Last</a></p><p>Top</p>',
]

PAGES = _NEWS + _ALONE + _PLAIN
