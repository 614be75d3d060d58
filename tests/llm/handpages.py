"""Pages written and labelled by hand, in layouts that the generator of training pages doesn't make: (name, html, main text)."""

LOREM = "The river rises in the hills and runs for forty miles before it meets the sea. Farmers along its banks have grown barley there for three hundred years, and most of them still do."
MORE = "In a dry summer the lower fields are watered by hand. Nobody remembers a year in which the well at the old mill ran dry, though in 1976 it came close."
LAST = "What will happen after the new road is built, no one can say for certain."

PAGES = [
    (
        "news with teasers between paragraphs",
        f"""<!doctype html><html><head><title>River</title><meta name="description" content="x"><script type="application/ld+json">{{"a":"<p>no</p>"}}</script></head>
<body class="article-page"><div id="cookie-banner" class="consent"><p>We use cookies to improve your visit.</p><button>Accept</button><a href="/privacy">Privacy policy</a></div>
<div class="masthead"><a href="/"><img src=l.png alt="The Daily"></a><ul class="main-nav"><li><a href=/n>News</a><li><a href=/s>Sport</a><li><a href=/c>Culture</a></ul></div>
<div class="story-body"><h1>A river and its barley</h1><p>{LOREM}</p><p>{MORE}</p>
<div class="advertisement"><span>Advertisement</span><p>Buy two, get one free.</p></div><h2>The road</h2><p>{LAST}</p></div>
<div class="related-stories"><h3>More on this</h3><ul><li><a href=/1>Mill to be sold</a></li><li><a href=/2>Council delays vote</a></li></ul></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely piece, thank you.</p></div><div class="comment"><p>I disagree about 1976.</p></div></div>
<div class="site-footer"><p>© 2021 The Daily. All rights reserved.</p></div></body></html>""",
        f"A river and its barley {LOREM} {MORE} The road {LAST}",
    ),
    (
        "main with header inside article",
        f"""<html><body><header role=banner><h2><a href=/>Fields &amp; Mills</a></h2><nav aria-label=Main><a href=/a>Home</a> <a href=/b>Archive</a> <a href=/c>About</a></nav></header>
<main id=main><article><h1>Barley &#8211; a history</h1><p>{LOREM}</p><ul><li>Sown in March, rolled in April.</li><li>Cut in August, when the ears are dry.</li></ul><blockquote><p>{LAST}</p></blockquote><p>{MORE}</p></article></main>
<aside class=sidebar><h3>Popular</h3><ol><li><a href=/x>Ten mills</a></li><li><a href=/y>Old wells</a></li></ol><form><label>Search</label><input name=q></form></aside>
<footer><ul><li><a href=/i>Imprint</a></li><li><a href=/k>Contact</a></li></ul></footer></body></html>""",
        f"Barley – a history {LOREM} Sown in March, rolled in April. Cut in August, when the ears are dry. {LAST} {MORE}",
    ),
    (
        "documentation page",
        f"""<body><div class="topbar"><a href=/>Docs</a><form class=search><label>Find</label><input></form></div><div class="layout"><div class="sidebar"><ul><li><a href=1>Install</a><ul><li><a href=2>Linux</a><li><a href=3>Windows</a></ul><li><a href=4>Use</a></ul></div>
<div class="content"><h1>Watering by hand</h1><p>{MORE}</p><h2>Pumps</h2><p>{LOREM}</p><pre>open valve
wait   10</pre><table><tr><th>Field</th><th>Days</th></tr><tr><td>Lower</td><td>three</td></tr></table><p>{LAST}</p></div></div><div class="footer">Built with care. <a href=/l>License</a></div></body>""",
        f"Watering by hand {MORE} Pumps {LOREM} open valve wait 10 Field Days Lower three {LAST}",
    ),
    (
        "blog post with share bar and subscription",
        f"""<body><div id=page><div id=header><h1 class=site-title><a href=/>Notes from the mill</a></h1></div><div id=menu><ul><li><a href=/>Home</a></li><li><a href=/about>About</a></li></ul></div>
<div class="post hentry"><h2 class=entry-title>Barley again</h2><div class="entry-content"><p>{LOREM}<p>{MORE}<p><em>{LAST}</em></div></div>
<div class="social-share"><ul><li><a href=#>Tweet</a></li><li><a href=#>Share</a></li></ul></div><div class="newsletter-signup"><h4>Stay in touch</h4><p>Get a letter every month.</p><form><input><button>Join</button></form></div>
<div id=respond class=comments><h3>Leave a reply</h3><p>Your address will not be shown.</p></div><div id=colophon>Powered by steam</div></div></body>""",
        f"Barley again {LOREM} {MORE} {LAST}",
    ),
    (
        "German, section instead of article",
        """<html lang=de><body><nav class="navbar"><ul><li><a href=/>Start</a></li><li><a href=/w>Wetter</a></li></ul></nav><section class="article"><h1>Der Fluss und die Gerste</h1><p>Der Flu&szlig; entspringt in den H&uuml;geln und flie&szlig;t vierzig Meilen, bevor er das Meer erreicht.</p><p>In trockenen Sommern werden die unteren Felder von Hand bew&auml;ssert. Niemand erinnert sich an ein Jahr ohne Wasser.</p></section><section class="kommentare comments"><h2>Kommentare</h2><div class=comment><p>Sehr schön, danke.</p></div></section><footer class="footer"><p>Impressum und Datenschutz</p></footer></body></html>""",
        "Der Fluss und die Gerste Der Fluß entspringt in den Hügeln und fließt vierzig Meilen, bevor er das Meer erreicht. In trockenen Sommern werden die unteren Felder von Hand bewässert. Niemand erinnert sich an ein Jahr ohne Wasser.",
    ),
    (
        "no article at all",
        """<body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul></nav><form><label>User</label><input><label>Word</label><input><button>Log in</button></form><footer>&copy; 2020</footer></body>""",
        "",
    ),
    (
        "article alone, unclosed paragraphs",
        f"<article><h1>Short</h1><p>{LOREM}<p>{MORE}<p>{LAST}</article>",
        f"Short {LOREM} {MORE} {LAST}",
    ),
    (
        "notice above, tags below, hidden script templates",
        f"""<body><div class="alert notice"><p>This site will be closed on Sunday for maintenance.</p></div><div class="wrapper"><main><h1>Wells</h1><p>{MORE}</p><p>{LOREM} <a href="/mill">Read about the mill</a> and its <b>wheel</b>.</p></main></div><noscript><p>Turn on scripts.</p></noscript><template><p>Template</p></template><div class="tags"><a href=/t/1>wells</a> <a href=/t/2>water</a></div><div class="footer"><a href=/>Back to start</a></div></body>""",
        f"Wells {MORE} {LOREM} Read about the mill and its wheel.",
    ),
]

#: Written after the last change of the generator and not looked at before.
FRESH = [
    (
        "encyclopedia",
        f"""<body><div id=mw-head><ul><li><a href=/r>Read</a></li><li><a href=/e>Edit</a></li><li><a href=/h>View history</a></li></ul></div><div id=content role=main><h1 id=firstHeading>Barley</h1><p>{LOREM}</p><h2>Watering</h2><p>{MORE}</p><ol><li>By hand, from the well.</li><li>By pump, from the river.</li></ol></div><div id=mw-panel><h3>Tools</h3><ul><li><a href=/w>What links here</a></li><li><a href=/p>Printable version</a></li></ul></div><footer id=footer><ul><li>This page was last edited in May.</li></ul></footer></body>""",
        f"Barley {LOREM} Watering {MORE} By hand, from the well. By pump, from the river.",
    ),
    (
        "press release in deep wrappers",
        f"""<body><div class=site><div class=site-inner><div class=header-area><div class=logo><a href=/>Mill Company</a></div></div><div class=content-area><div class=row><div class=col><article class="press"><header><h1>New wheel for the mill</h1></header><div class=body><p>{LAST}</p><p>{LOREM}</p></div></article></div><aside class=col><h4>Contact</h4><p>Press office, 12 River Lane.</p></aside></div></div><div class=footer-area><p>Mill Company 2022</p></div></div></div></body>""",
        f"{LAST} {LOREM}",  # its heading stands in a header element, and headers don't count
    ),
    (
        "French, forms and breadcrumbs",
        """<body><nav class=breadcrumb><a href=/>Accueil</a> &gt; <a href=/v>Vie</a></nav><article><h1>L&#8217;&eacute;t&eacute; sec</h1><p>Dans les &eacute;t&eacute;s secs, les champs du bas sont arros&eacute;s &agrave; la main.</p><p>Personne ne se souvient d&#39;une ann&eacute;e sans eau.<br>Le puits du vieux moulin n&#39;a jamais tari.</p></article><form class=contact><label>Votre nom</label><input><textarea>...</textarea><button>Envoyer</button></form><footer><p>Mentions l&eacute;gales</p></footer></body>""",
        "L’été sec Dans les étés secs, les champs du bas sont arrosés à la main. Personne ne se souvient d'une année sans eau. Le puits du vieux moulin n'a jamais tari.",
    ),
    (
        "long discussion under a short article",
        f"""<body><div class=nav><a href=/>Home</a></div><main><h1>Short note</h1><p>{LAST}</p></main><section id=comments class=comment-list>{"".join(f"<div class=comment><h4>Reader {k}</h4><p>{MORE}</p></div>" for k in range(12))}</section><div class=footer>End</div></body>""",
        f"Short note {LAST}",
    ),
]
