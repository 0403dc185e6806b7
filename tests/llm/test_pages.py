import random

from seriesmill.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>{article}<aside>Side</aside><form>Name <input></form>
<section id="comments"><article class="comment">First!</article></section><footer>&copy; me</footer></body></html>"""


def text(html):
    return "\n".join(t for k, t in pages.lines_of(html) if k >= pages.ASKED)


def test_article():
    article = "<article><header><h1>A &amp; B</h1></header><p>one <b>two</b>\n  three&nbsp;four<p>&lt;five&gt; 5 < 6 <!-- <p>no</p> --></article>"
    assert text(PAGE.format(article=article)) == "A & B\none two three four\n<five> 5 < 6"
    assert text(PAGE.format(article="<main><div>x<div>y</div>z</div></main>")) == "x\ny\nz"


def test_broken_markup():
    assert text(None) == text("") == "" and text("just text") == "just text"
    assert text("<article><p>a<math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</article>") == "ax=2 b"
    assert text("<article><p>a<div class=ad>buy</div><p>b") == "a\nb"
    assert text("<nav><ul><li>x<article><p>kept</p></article>") == "kept"
    assert text("<p>a</span></div></p>b<!-- never closed <p>c") == "a\nb"
    assert text('<article><p title="a > b">x</p><script>never closed') == "x"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence(monkeypatch):
    random.seed(5)
    for k in range(600):
        monkeypatch.setattr(pages, "TABLE_BITS", 1 << 28 if k % 2 else 20)
        a, b = ([random.randrange(random.choice((2, 4))) for _ in range(random.randrange(14))] for _ in range(2))
        places = pages.common_lines(a, b)
        assert len(places) == lcs(a, b) and all(a[i] == b[j] for i, j in places)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(places, places[1:]))


def test_long_pages_with_one_repeated_line():
    a, b = [1] * 4000 + [2], [3] + [1] * 4000
    assert len(pages.common_lines(a, b)) == 4000
    line = "<p>again</p>" * 3000
    assert len(pages.lines_of(line)) == 3000


def test_names_of_parts_of_an_article():
    """Only whole names of the list count, and inside an article they only put a line in question."""
    html = '<article><h1 class="section-header">t</h1><p class="foot-note">n</p><p id="search-results-explained">s</p><div class="share">d</div><p><math><mi>x</mi></math></p></article>'
    assert text(html) == "t\nn\ns\nd\nx"
    assert [k for k, _ in pages.lines_of(html)] == [pages.CONTENT] * 3 + [pages.ASKED, pages.CONTENT]
    assert pages.deleted_lines([3, 2], [1, 2], [3, 2], [5, 2]) == [1] and pages.deleted_lines([3, 2], [1, 2], [3, 2], [2, 1]) in ([], [1])


def segments(path):
    out, part = [], ""
    for c in path:
        part += c
        if c in "/?&#._-":
            out.append(part)
            part = ""
    return [*out, part]


def test_against_brute_force(spark):
    """Pairing, alignment and deletion on random hosts, in plain Python; frame lines keep their order, so alignments are unique."""
    random.seed(9)
    site = {}
    for k in range(160):
        host = f"h{min(k // 4 % 7, 3)}.example"
        path = "/" + "/".join(random.choice("abc") * random.randrange(1, 3) for _ in range(random.randrange(1, 4))) + f"/{k}"
        frame = [f"{host} line {n}" for n in range(8) if random.random() < 0.7]
        own = [f"own {k} {n}" for n in range(random.randrange(3))]
        at = random.randrange(len(frame) + 1)
        lines = [(t, "div") for t in frame[:at]] + [(t, "div") for t in own] + [(t, "div") for t in frame[at:]]
        if random.random() < 0.5:
            lines.append((f"{host} line in an article", "article"))
        site[k] = (host, path, lines)
    rows = [(k, f"https://{h}{p}", "<body>" + "".join(f"<{e}>{t}</{e}>" for t, e in lines) + "</body>") for k, (h, p, lines) in site.items()]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    by_host = {}
    for k, (h, p, _) in site.items():
        by_host.setdefault(h, []).append((p, k))
    deleted = 0
    for order in map(sorted, by_host.values()):
        for i, (path, k) in enumerate(order):
            mine = site[k][2]
            best = None
            for j in (i - 1, i + 1):
                if 0 <= j < len(order):
                    other = site[order[j][1]][2]
                    same = 0
                    for x, y in zip(segments(path), segments(order[j][0])):
                        if x != y:
                            break
                        same += 1
                    rank = ([t for t, _ in other] != [t for t, _ in mine], same)
                    if best is None or rank > best[0]:
                        best = rank, {t for t, _ in other}
            shared = best[1] if best else set()
            open_lines = [t for t, e in mine if e == "div"]
            gone = {t for t in open_lines if t in shared}
            if all(e == "div" for _, e in mine) and len(gone) == len(open_lines):
                gone = set()
            deleted += len(gone)
            want = [t for t, _ in mine if t not in gone]
            assert (got[k].text, got[k].n_lines, got[k].n_shared, got[k].n_frame) == ("\n".join(want), len(mine), len(gone), 0)
    assert deleted > 300


def test_shared_frame_goes(spark):
    page = "<html><body><p>Menu of all</p><div>{}</div><p>{}</p><p>Imprint</p></body></html>"
    rows = [(k, f"http://h/{k // 2}/{k % 2}", page.format(f"title {k}", f"story {k}")) for k in range(4)]
    rows += [(9, "http://other/1", page.format("alone", "kept")), (10, None, None), (11, None, ""), (12, "x", "plain"), (0, *rows[0][1:])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.main_text(table).collect())
    want = [(k, f"title {k}\nstory {k}") for k in (0, 0, 1, 2, 3)] + [(9, "Menu of all\nalone\nkept\nImprint"), (10, ""), (11, ""), (12, "plain")]
    assert got == [(k, t, len(t)) for k, t in want]
    assert pages.main_text(table.where("false")).count() == 0


def test_copies_and_articles_stay(spark):
    rows = [(k, f"http://h/a/{k}", "<article><h1>Same</h1><p>text</p></article>") for k in range(3)] + [(k, f"http://h/b/{k}", "<p>only</p>") for k in range(3, 6)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Same\ntext", 1: "Same\ntext", 2: "Same\ntext", 3: "only", 4: "only", 5: "only"}


def test_odd_pages(spark, odd):
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(odd)] + [(None, None, "<p>x"), (1, "http://h/1", ""), (1, "http://h/1", "")]
    got = [(r.page_id, r.text) for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS shared", "html AS key")).collect()]
    assert len(got) == len(rows) and all(t is not None for _, t in got)
    assert dict(got)[7] == "x" * 5000 and dict(got)[8] == ("word " * 3000).strip() and dict(got)[None] == "x"
