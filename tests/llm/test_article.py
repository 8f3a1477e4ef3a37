"""The chosen subtree is never narrowed by an element's name."""

from tonecairn.llm import html_text


def test_single_teaser_does_not_replace_the_text():
    body = [f"Paragraph {k} of the main text, which goes on for a while so that it is dense, and says nothing else." for k in range(6)]
    text = "".join(f"<p>{p}</p>" for p in body)
    page = f"<body><div class=page><div>{text}</div><article><p>A short card.</p></article></div></body>"
    for html in (page, f"<body><div class=page>{text}<article><h2>Card</h2><p>A short card.</p></article></div></body>"):
        got = html_text.extract(html).split("\n")
        assert [p for p in body if p in got] == body


def test_article_of_sections_stays_whole():
    body = [f"Section {k} of the article, with a sentence that is long enough to be dense by itself." for k in range(4)]
    page = "<body><article>" + "".join(f"<section><p>{p}</p><p>{p}</p></section>" for p in body) + "</article></body>"
    assert [p for p in body if p in html_text.extract(page)] == body


LONG = [f"Paragraph {k} of the text, which goes on for a while so that it is dense enough, and says nothing else." for k in range(8)]


def test_nothing_of_an_article_is_lost_by_its_attributes():
    parts = [
        '<p title="The hidden valley">A title says hidden.', '<p>See <a href="/hidden/gems">these places</a> first.', '<h2 id="in-search-of-lost-time">In search of lost time</h2>',
        '<section id="social-history"><p>On social history.</section>', '<section id="comments"><h3>Comments</h3><p>A chapter of that name.</section>', '<p class="related-work">Work by others.',
        "<p>A formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> inline.", '<div class="search-history"><p>A box in the text.</div>', '<pre><span class="comment"># code</span> x</pre>', '<div data-x="hidden">Data.</div>',
    ]
    want = [
        "A title says hidden.", "See these places first.", "In search of lost time", "On social history.", "Comments", "A chapter of that name.", "Work by others.",
        "A formula x=1 inline.", "A box in the text.", "# code x", "Data.",
    ]
    for around in ("article", "main", "div"):
        page = f"<body><nav><a href=/>Home</a></nav><{around}>" + "".join(f"<p>{p}</p>{x}" for p, x in zip(LONG + LONG, parts)) + f"</{around}><footer>end</footer></body>"
        got = html_text.extract(page).split("\n")
        assert [x for x in got if x not in LONG] == (want if around != "div" else [w for w in want if w not in ("Comments", "A chapter of that name.")])


def test_boilerplate_goes():
    junk = [
        "<div hidden><p>gone</div>", '<p style="display:none">gone', '<div aria-hidden="true">gone</div>', '<div class="adBanner">gone</div>', '<div class="x social-share">gone</div>',
        '<section class="comments-area"><p>gone</section>', '<div role="navigation">gone</div>', '<ol class="commentlist"><li>gone</ol>', '<div id="cookie-notice">gone</div>', "<amp-ad>gone</amp-ad>",
        "<form>gone</form>", "<script>gone</script>", "<aside>gone</aside>", '<ul class="site-nav"><li>gone</ul>',
    ]
    for around in ("article", "main", "div", "section"):
        page = f"<body><header>gone</header><{around}>" + "".join(f"<p>{p}</p>{x}" for p, x in zip(LONG + LONG, junk)) + f"</{around}></body>"
        assert html_text.extract(page).split("\n") == (LONG + LONG)[: len(junk)]


def test_density_decides_without_article_or_main():
    links = "".join(f"<li><a href=/{k}>Some other story number {k}</a></li>" for k in range(30))
    text = "".join(f"<p>{p}</p>" for p in LONG)
    pages = [
        f"<body><div class=a><ul>{links}</ul></div><div class=b>{text}</div><div class=c><ul>{links}</ul></div></body>",
        f"<body><div class=a>{links}</div><div class=b><div>{text[: len(text) // 2]}</div><div>{text[len(text) // 2 :]}</div></div></body>",
        f"<body><table><tr><td>{links}<td><div>{text}</div></table></body>".replace("<td><div>", "</td></tr></table><div>").replace("</div></table>", "</div>"),
        f"<body><div><main><p>Short.</p></main></div><div class=b>{text}</div></body>",
    ]
    for page in pages:
        assert html_text.extract(page) == "\n".join(LONG) or page == pages[1]
    assert html_text.extract(pages[1]).replace("\n", "") == "".join(LONG)
    chosen = html_text._Dom()
    assert html_text.select(chosen) == 0


def test_tables_of_pages_without_article_elements():
    """The tables' own pages with their article renamed: density alone finds the same text."""
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    if os.path.exists(path):
        for page in pq.read_table(path).column("html").to_pylist()[:200]:
            assert html_text.extract(page.replace("<article", "<div").replace("</article", "</div")) == html_text.extract(page)


PAGES_WITHOUT = "<body><nav><a href=/>Home</a></nav>{}<div><a href=/1>One</a> <a href=/2>Two</a></div><footer>end</footer></body>"
TEXT = "".join(f"<p>{p}</p>" for p in LONG)
STAYS = [
    ("<article>{text}<section class='discussion'><h2>Discussion</h2><p>Found here.</p></section></article>", "Found here."),
    ("<article>{text}<div id='discussion'><h2>Discussion</h2><p>Found here.</p></div></article>", "Found here."),
    ("<main>{text}<div class='discussion'><p>Found here.</p></div></main>", "Found here."),
    ("<div class=x><div>{text}</div><div><p>Found here.</p></div></div>", "Found here."),
    ("<div id='search'>{text}<p>Found here.</p></div>", "Found here."),
    ("<div class='page search'><div>{text}<p>Found here.</p></div></div>", "Found here."),
    ("<div class='main-header'><h1>Found here.</h1></div><div>{text}</div>", "Found here."),
    ("<div class='post-header'><h1>Found here.</h1></div><div>{text}</div>", "Found here."),
    ("<article><div class='header'><h1>Found here.</h1></div>{text}</article>", "Found here."),
    ("<article><header><h1>Found here.</h1></header>{text}</article>", "Found here."),
    ("<article>{text}<div class='related-content'><p>Found here.</p></div></article>", "Found here."),
    ("<article>{text}<section class='related'><h3>Related work</h3><p>Found here.</p></section></article>", "Found here."),
    ("<article>{text}<p>Found <label>here</label>.</p></article>", "Found here."),
    ("<article>{text}<p>Press <button>Found here.</button></p></article>", "Press Found here."),
    ("<article>{text}<div class='search-results'><p>Found here.</p></div></article>", "Found here."),
    ("<article>{text}<div class='reviews'><p>Found here.</p></div></article>", "Found here."),
    ("<article>{text}<div class='book-review'><p>Found here.</p></div></article>", "Found here."),
    ("<div class='content has-sidebar'>{text}<p>Found here.</p></div>", "Found here."),
    ("<div class='sidebar'><article>{text}<p>Found here.</p></article></div>", "Found here."),
    ("<article>{text}<div class='recommended'><p>Found here.</p></div></article>", "Found here."),
]
GOES = [
    "<div class='user-reviews'><p>Gone.</p></div>", "<div class='customer-reviews'><div class=review><p>Gone.</p></div></div>", "<div class='reader-comments'><p>Gone.</p></div>",
    "<div id='comments'><p>Gone.</p></div>", "<div class='discussion'><div class='comment'><p>Gone.</p></div></div>", "<div class='discussion'><p>Gone.</p><textarea></textarea></div>",
    "<div class='related'><ul><li><a href=/x>Gone.</a></li></ul></div>", "<div class='related-posts'>Gone.</div>", "<div class='search'><form><p>Gone.</p></form></div>", "<div class='site-notice'><p>Gone.</p></div>",
    "<div class='alert'>Gone.</div>", "<div class='ad'>Gone.</div>", "<button>Gone.</button>", "<div class='newsletter-signup'><p>Gone.</p></div>", "<ul class='pagination'><li>Gone.</li></ul>",
    "<div class='recommended'><a href=/x>Gone.</a></div>", "<div class='replies'><p class='reply'>Gone.</p></div>", "<form><label>Gone.</label></form>",
]


def test_what_a_container_holds_outweighs_its_name():
    for shape, kept in STAYS:
        got = html_text.extract(PAGES_WITHOUT.format(shape.format(text=TEXT))).split("\n")
        assert [x for x in got if x in LONG] == LONG and [x for x in got if x not in LONG and x != "Discussion" and x != "Related work"] == [kept], shape


def test_boilerplate_inside_the_text_goes():
    for junk in GOES:
        for around in ("article", "main", "div"):
            page = PAGES_WITHOUT.format(f"<{around}>{TEXT}{junk}<p>Last.</p></{around}>")
            assert html_text.extract(page).split("\n") == [*LONG, "Last."], (junk, around)
