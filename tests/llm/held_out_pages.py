"""Pages with their main texts, written apart from those that the model is trained on."""

LOREM = "The council met on Tuesday to talk about the old bridge, which has been closed since the spring flood."
MORE = "Engineers said that the pillars can be saved, but the deck has to be built anew before winter comes."
LAST = "A vote on the money is planned for next month."

#: (html, main text)
PAGES = [
    (f"<html><head><title>T</title></head><body><header><div class='brand'>Daily</div><nav><a href='/'>Home</a><a href='/n'>News</a></nav></header><main><article><h1>Bridge</h1><p>{LOREM}</p><p>{MORE}</p></article></main><footer><p>About us</p></footer></body></html>", f"Bridge\n{LOREM}\n{MORE}"),
    (f"<body><div id='top-nav'><ul><li><a>One</a><li><a>Two</a></ul></div><div class='post-content'><p>{LOREM}<p>{MORE}<p>{LAST}</div><div class='comments-area'><p>First!</p><p>I do not agree with any of this, and I say so.</p></div></body>", f"{LOREM}\n{MORE}\n{LAST}"),
    (f"<div class='article-share-body'><p>{LOREM}</p></div>", LOREM),
    (f"<body class='single has-sidebar'><div class='wrap'><article><p>{LOREM}</p><svg viewBox='0 0 1 1'/><p>{MORE}</p></article><aside class='widget'><p>Most read today</p></aside></div></body>", f"{LOREM}\n{MORE}"),
    (f"<main><p title=it's>{LOREM}</p><video-player src=x>caption</video-player><p>{MORE}</p></main>", f"{LOREM}\ncaption\n{MORE}"),
    (f"<body><div class='cookie-bar'><p>We use cookies.</p><button>OK</button></div><section class='story'><h2>Bridge</h2><p>{LOREM}</p><div class='ad-slot'><p>Shoes at half price</p></div><p>{MORE}</p></section><div class='related'><h3>Read on</h3><ul><li><a>Flood</a></li></ul></div></body>", f"Bridge\n{LOREM}\n{MORE}"),
    (f"<body><form action='/s'><label>Search</label><input name=q></form><table><tr><td>{LOREM}</td></tr><tr><td>{MORE}</td></tr></table><div class='footer-links'><a>Terms</a><a>Privacy</a></div></body>", f"{LOREM}\n{MORE}"),
    (f"<article><h1>Bridge &amp; flood</h1><p>{LOREM}</p><blockquote>{LAST}</blockquote><ul><li>deck</li><li>pillars</li></ul><figure><img src=x><figcaption>The bridge in May</figcaption></figure></article><script>var a = '<p>no</p>';</script><style>p {{}}</style>", f"Bridge & flood\n{LOREM}\n{LAST}\ndeck\npillars\nThe bridge in May"),
    ("<body><nav><ul><li><a>Home</a></li><li><a>Shop</a></li></ul></nav><footer>(c) Shop</footer></body>", ""),
    (f"<body><div role=banner><a>Logo</a></div><div role=main><p>{LOREM}</p><math><mi>x</mi><p>{MORE}</p></div><div role=complementary class=sidebar><p>Our pick of the week</p></div></body>", f"{LOREM}\n{MORE}"),
    (f"<body><div class='newsletter-signup'><p>Get our news by mail</p></div><div><p>{LOREM}</p><p>{MORE}</p><p>{LAST}</p></div><div class='share-buttons'><a>Mail</a></div></body>", f"{LOREM}\n{MORE}\n{LAST}"),
    (f"<body><div class='page'><div class='content'><h1>Bridge</h1><p>{LOREM}</p><div class='notice'><p>This page was moved.</p></div><p>{MORE}</p></div><ol class='commentlist'><li><p>Long live the bridge, it was there before us all and will be after.</p></li><li><p>Nobody asked me about it.</p></li></ol></div></body>", f"Bridge\n{LOREM}\n{MORE}"),
]
