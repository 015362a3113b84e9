import random

from tessera.llm.htmltext import blocks, extract, parse, path_ratios

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- x --><div class="ad">Buy now, it is cheap.</div>
<article><h1>A &amp; B</h1><p><b>One two.<br><p>It said&nbsp;&ldquo;yes&rdquo;,
  and   then <a href="x>y">left</a>. Then it came back.<aside>See also</aside><form>Mail <input></form><div id="comments"><p>Nice text, I liked it.</div>
<p>Last &lt;one&gt;.</article><div class="cookie-notice">We use cookies.</div><footer>&copy; us</footer>"""


def test_article_without_the_rest():
    assert blocks(PAGE) == ["A & B", "One two.", "It said “yes”, and then left. Then it came back.", "Last <one>."]


def test_without_article_element():
    long = "Here is a paragraph with some length, and with commas; it ends here. "
    page = f"<body><div class=menu><a>One</a> <a>Two</a></div><div><div class=body><p>{long * 3}</p><p>{long}</p><ul><li>Point one.<li>Point two.</ul></div><div class='comment-list'><p>{long}</p></div></div>"
    assert blocks(page) == [(long * 3).strip(), long.strip(), "Point one.", "Point two."]


def test_chosen_text_beside_the_largest_part():
    point = "A point of the list, which says something; and then, a bit more of it. "
    intro = "An introduction, of <b>some</b> length, to what follows; it has commas, and ends here."
    last = "The last section, short as it is, has its own element. It ends, too."
    page = f"<body><div class=menu><a>One</a></div><div><p>{intro}</p><ul>{f'<li>{point}' * 12}</ul><p>{last}</p></div><div class=footer>{last}</div></body>"
    assert blocks(page) == [intro.replace("<b>", "").replace("</b>", ""), *[point.strip()] * 12, last]


def test_frame_named_after_a_part():
    page = "<div class='layout with-sidebar'><div class=sidebar>Links, links.</div><article><p>The text, at last. It is here.</p></article></div>"
    assert blocks(page) == ["The text, at last. It is here."]


def test_awkward_pages():
    assert blocks(None) == blocks("") == blocks("<script>x") == blocks("<nav class='ads'>x</nav>") == []
    assert blocks("<div class='ads'>x</div>") == ["x"]
    assert blocks("a < b &am") == ["a < b &am"]
    assert blocks("<p>one<p>two<b") == ["one", "two"]
    assert len(blocks("<div>" * 3000 + "deep" + "</div>" * 10)) == 1
    assert blocks("<table><tr><td>x, y.<td>z.</table>") == ["x, y.", "z."]


def test_path_table():
    rows = path_ratios(*parse("<article><p>Hello, you.</p><p>Me.</p></article>"))
    assert [r[:4] for r in rows] == [("/article/p", 2, 14, 3)]


def random_page(rng):
    """A page of nested elements, and its texts as (path, text) in page order."""
    texts = []

    def words():
        return " ".join(rng.choice(["one", "two,", "three.", "four; five", "six"]) for _ in range(rng.randrange(0, 12)))

    def element(path, depth):
        out = []
        for _ in range(rng.randrange(1, 5) if depth < 4 else 1):
            w = words()
            texts.append((path, w))
            out.append(w)
            if depth < 4:
                tag = rng.choice(["div", "section", "blockquote", "pre"])
                out.append(f"<{tag}>{element(f'{path}/{tag}', depth + 1)}</{tag}>")
        return "".join(out)

    return f"<body>{element('/body', 0)}</body>", [(p, t) for p, t in texts if t]


def test_ratios_match_plain_sums():
    rng = random.Random(5)
    for _ in range(30):
        page, texts = random_page(rng)
        sums = {}
        for path, t in texts:
            n, size, marks = sums.get(path, (0, 0, 0))
            sums[path] = (n + 1, size + len(t), marks + sum(c in ".,;" for c in t))
        rows = list(sums.items())
        want = []
        for i, (path, (n, size, marks)) in enumerate(rows):
            near = [(rows[j][1], 1 if j == i else 0.25) for j in (i - 1, i, i + 1) if 0 <= j < len(rows)] if len(rows) > 2 else [(rows[i][1], 1)]
            weight = sum(w for _, w in near)
            length, punctuation = (sum(w * x[k] / x[0] for x, w in near) / weight for k in (1, 2))
            want.append((path, n, size, marks, length * (1 + punctuation)))
        got = path_ratios(*parse(page))
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert all(abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want))


def test_operator(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (None, "v", "", "x"), (1, "u", PAGE, "old")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.n_chars, r.text) for r in extract(df).collect())
    text = " ".join(blocks(PAGE))
    assert got == [("1", len(text), text), ("1", len(text), text), ("2", 0, ""), ("None", 0, "")]
    assert extract(df.limit(0)).collect() == []
