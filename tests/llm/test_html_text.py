import html
import re
import time

from meshwork.llm import html_text

ARTICLE = "<article><h1>A title</h1><p>First &amp; second\n\tword<br>third.</p><p><b>Bold<p>Unclosed <a href='/x'>link</a> text</article>"
WANT = "A title\nFirst & second word third.\nBold\nUnclosed link text"


def brute(source):
    """The given pages' articles by cutting at their block tags."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = (html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, brute(r.html)) for r in pages.collect()}
    got = html_text.op11_html_text(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_furniture_goes():
    long = "many words of a long text " * 20
    around = (
        f"<header><p>{long}</p></header><nav><a href=/a>{long}</a></nav><aside>{long}</aside><div class='cookie-notice'><p>{long}</p></div>"
        f"<div id=ad-1>{long}</div><form><p>{long}</p><input></form><script>var a = '</p><article>{long}</article>';</script>"
    )
    after = f"<section class=\"reader comments\"><article class=comment><p>{long}</p></article><p>{long}</p></section><footer>{long}"
    assert html_text.extract(f"<html><head><title>{long}</title></head><body>{around}{ARTICLE}{after}") == WANT
    inside = ARTICLE.replace("<p><b>", f"<div class=\"ad\">{long}</div><span class='ad'>{long}</span><!-- {long} --><p><b>")
    assert html_text.extract(f"<body>{around}{inside}{after}</body>") == WANT
    assert html_text.extract(f"<div class=has-sidebar><div id=sidebar>{long}</div>{ARTICLE}</div>") == WANT
    assert html_text.extract(around) == ""


def test_density_without_landmarks():
    text = "".join(f"<p>Paragraph {i} has a good many words that say something to its reader, and no links at all.</p>" for i in range(6))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i} goes elsewhere</a></li>" for i in range(12)) + "</ul>"
    got = html_text.extract(f"<body><div>{links}</div><div><div>{text}<ul><li>short item</ul></div></div><div>{links}<p>ab</p></div></body>")
    assert got.split("\n") == [f"Paragraph {i} has a good many words that say something to its reader, and no links at all." for i in range(6)] + ["short item"]


def test_densities_by_definition():
    page = html_text.Page("<div><p>aaaa</p><p>bb <a>cccc</a></p></div>")
    density, total = page.densities()
    import math

    share = 4 / 10
    leaf = [4 / 1 * math.log(4) / math.log(math.log(4 / 4 * 1 + share * 4 + math.e)), 6 / 1 * math.log(6 / 4) / math.log(math.log(6 / 2 * 4 + share * 6 + math.e))]
    assert [round(x, 9) for x in density[2:4]] == [round(x, 9) for x in leaf]
    assert abs(total[1] - sum(leaf)) < 1e-9
    assert abs(density[1] - 10 / 3 * math.log(10 / 4 * 3) / math.log(math.log(10 / 6 * 4 + share * 10 + math.e))) < 1e-9


def test_odd_pages_take_linear_time():
    began = time.time()
    n = 60_000
    for odd in ("<div>" * n + "x", "<p><b>" * n + "x", "<a <a <a " * n, "<!--" * n, "<" * n, '<p a="' * n, "</p>" * n, "<script>" * n, "<li>" * n + "y", "&" * n, "<table><tr><td>" * (n // 10) + "z", "<article>" * 3000 + "t"):
        html_text.extract(odd)
    assert time.time() - began < 60
    assert html_text.extract("<article>" + "<p>word</p>" * n + "</article>") == "\n".join(["word"] * n)


def test_tables_lists_and_references():
    got = html_text.extract("<main><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<ul><li>y</ul><li>z</ul>&lt;p&gt; &#233;&nbsp;&eacute; 1 < 2 <3</main>")
    assert got == "a\nb\nc\nx\ny\nz\n<p> é é 1 < 2 <3"


def test_rows_nulls_clashes_and_empty_tables(spark):
    rows = [(1, "u", None, "t"), (1, "u", "", None), (None, None, ARTICLE, "t"), (2, "v", ARTICLE, "t"), (2, "v", ARTICLE, "t"), (3, "w", "no markup at all", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `Te.xt` string").withColumnRenamed("Te.xt", "Text").repartition(3)
    got = html_text.main_text(df)
    assert got.columns == ["page_id", "url", "Text", "text_", "n_chars"]
    assert sorted((r.page_id or 0, r.text_, r.n_chars) for r in got.collect()) == sorted([(1, "", 0), (1, "", 0), (0, WANT, len(WANT)), (2, WANT, len(WANT)), (2, WANT, len(WANT)), (3, "no markup at all", 16)])
    assert html_text.main_text(df.limit(0)).count() == 0
