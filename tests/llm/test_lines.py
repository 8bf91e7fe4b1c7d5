"""Site lines, page differencing and their helpers."""

from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeel.llm import lines, mainbody, sitelines

T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
PAGES = "id string, url_node_id string, content_text string, content_html string, created_at timestamp, fetched_at timestamp, site string, node string, s string, key string"
NODES = "id string, domain string, url string, node string, site string"


def pages(spark, data):
    return spark.createDataFrame([(i, n, t, h, at, at, "x", "y", "z", "k") for i, n, t, h, at in data], PAGES)


def nodes(spark, data):
    return spark.createDataFrame([(i, d, u, "a", "b") for i, d, u in data], NODES)


def test_line_words():
    assert lines.line_words("Written by Ann Lee on 2023-04-01") == lines.line_words("  WRITTEN BY ann lee, on 3 March 2021! »")[:4] + ["on", "%d"]
    assert lines.line_words("Nothing lives at /a/b-1 any more.") == ["nothing", "lives", "at", "%a", "any", "more"]
    assert lines.line_words("Join 1,234 readers") == lines.line_words("join 9 readers") == ["join", "%n", "readers"]
    assert lines.line_words("Déjà  Vu\xa0!") == ["deja", "vu"]
    assert lines.line_words(" · — ") == [] and lines.key_of([]) == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_keys_ignore_case_and_marks(line):
    words = lines.line_words(line)
    assert all(words)
    if line.isascii() and not any(c.isdigit() or c in "./@:" for c in line):
        assert lines.key_of(lines.line_words("» " + line.upper().replace(" ", "  ") + " !")) == lines.key_of(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_aligned_is_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y and x else max(best[i][j + 1], best[i + 1][j])
    pairs = mainbody.aligned(a, b)
    assert len(pairs) == best[-1][-1]
    assert all(a[i] == b[j] and a[i] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def site_lines(spark, data, known, **kw):
    return {(r["id"], r["line_no"]) for r in sitelines.repeated_lines(pages(spark, data), nodes(spark, known), **kw).collect()}


def test_lines_count_on_distinct_pages_of_one_site(spark):
    known = [(f"n{i}", ["Site.example", "www.site.example"][i % 2], f"https://site.example/{i}") for i in range(9)] + [("m0", "other.example", "https://other.example/")]
    data = [(f"p{i}", f"n{i}", f"Own line number {'abcdefghi'[i]}\n\nShared  Line, {i} times!\nBy Ann{'abcdefghi'[i]} Lee, 2024-01-0{i + 1}", None, T0) for i in range(8)]
    data += [("q", "m0", "Shared line 5 times", None, T0), ("p0", "n0", data[0][2], None, T0), ("v", "n0", "Shared line 3 times", None, T1), ("x", "n8", None, None, T0), ("y", "nowhere", "Shared line 1 times", None, T0), (None, "n1", "Shared line 1 times", None, T0), ("e", "n8", "", None, T0)]
    want = {(f"p{i}", n) for i in range(8) for n in (2, 3)} | {("v", 0)}
    assert site_lines(spark, data, known) == want
    # Seven pages are too few; versions of one page count once.
    assert site_lines(spark, [d for d in data if d[0] != "p7"], known) == set()


def test_bylines_unify_whatever_other_sites_hold(spark):
    names = ["Ann Lee", "Bob Ray", "Ann Maria Poe"]
    known = [(f"n{i}", "s.example", "u") for i in range(9)] + [(f"m{i}", f"other{i}.example", "u") for i in range(5)]
    data = [(f"p{i}", f"n{i}", f"By {names[i % 3]}, 2024-01-0{i + 1}", None, T0) for i in range(9)]
    want = {(f"p{i}", 0) for i in range(9)}
    assert site_lines(spark, data, known) == want
    # The same names on many other sites change nothing.
    assert site_lines(spark, data + [(f"q{i}{k}", f"m{i}", f"By {names[k]}, 2024-01-01", None, T0) for i in range(5) for k in range(3)], known) == want


def test_notices_with_dates_are_no_names(spark):
    known = [(f"n{i}", "s.example", "u") for i in range(14)]
    # Seven pages each: two wordings of a notice, and a notice beside bylines.
    data = [(f"p{i}", f"n{i}", f"{['Posted', 'Updated'][i % 2]} on 2024-01-0{i % 9 + 1}", None, T0) for i in range(14)]
    assert site_lines(spark, data, known) == set()
    data = [(f"p{i}", f"n{i}", "Last checked: 2024-01-01" if i < 7 else f"By {'ABC'[i % 3]}nn {'XYZ'[i % 3]}oe, 2024-01-01", None, T0) for i in range(14)]
    assert site_lines(spark, data, known) == set()


def test_last_delivery_counts(spark):
    known = [(f"n{i}", "s.example", "u") for i in range(8)]
    data = [(f"p{i}", f"n{i}", "menu", None, T0) for i in range(8)] + [("p0", "n0", "other\nmenu", None, T1)]
    assert site_lines(spark, data, known) == {("p0", 1)} | {(f"p{i}", 0) for i in range(1, 8)}


def test_republished_articles_can_be_told_from_boilerplate(spark):
    known = [(f"n{i}", "s.example", "u") for i in range(10)]
    data = [(f"p{i}", f"n{i}", "an article in one line\nand another", None, T0) for i in range(10)]
    assert len(site_lines(spark, data, known)) == 20
    assert site_lines(spark, data, known, min_texts=2) == set()
    assert site_lines(spark, data, known, min_dates=2) == set()


def test_edited_copies_are_one_cluster(spark):
    known = [(f"n{i}", "s.example", "u") for i in range(10)]
    article = "\n".join(f"Line {'abcdefghij'[k]} of a long report on {'klmnopqrst'[k]} and what came of it in the end" for k in range(10))
    data = [(f"p{i}", f"n{i}", article + f"\nnote {'abcdefghij'[i]}", None, [T0, T1][i % 2]) for i in range(10)]
    assert len(site_lines(spark, data, known)) == 100
    assert site_lines(spark, data, known, min_texts=2) == set()


def test_pages_texts_and_dates_are_returned(spark):
    known = [(f"n{i}", "s.example", "u") for i in range(8)]
    data = [(f"p{i}", f"n{i}", f"menu\nown {'ab'[i % 2]}", None, [T0, T1][i % 2]) for i in range(8)]
    got = sitelines.repeated_lines(pages(spark, data), nodes(spark, known)).collect()
    assert {(r["id"], r["line_no"], r["pages"], r["texts"], r["dates"]) for r in got} == {(f"p{i}", 0, 8, 2, 2) for i in range(8)}


def test_removal_keeps_other_lines(spark):
    df = spark.createDataFrame([("a", "x\ny\n\nz", 1), ("b", "q", 2), ("c", None, 3)], "id string, content_text string, _x int")
    gone = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3)], "id string, line_no int")
    assert {r["id"]: r["content_text"] for r in sitelines.without_lines(df, gone).collect()} == {"a": "x\n", "b": "q", "c": None}


def test_empty_tables(spark):
    assert site_lines(spark, [], []) == set()
    assert mainbody.boilerplate_lines(pages(spark, []), nodes(spark, [])).count() == 0


def body(i):
    return f"Title number {'abcdefgh'[i]} of this page says how things are\nThe {'abcdefgh'[i]} sentence of this body is only here.\nPass it on"


def markup(i, nav=True):
    lines_ = body(i).split("\n")
    return (
        "<html><head><script>var a='<p>nav</p>';</script></head><body>"
        + ("<nav><ul><li><a href=/1>Home</a><li><a href=/2>News</a></ul></nav>" if nav else "")
        + f"<div class='x sidebar-layout'><h1>{lines_[0]}</h1><p>{lines_[1]}<small>{lines_[2]}</small></div>"
        + "<aside><h3>Most read</h3><ul>" + "".join(f"<li><a href=/e>Entry {'abcdefgh'[i]} {'xy'[k]} with a title of seven words</a>" for k in range(2)) + "</ul></aside>"
        + "<footer><p>All rights reserved</p></footer></body></html>"
    )


def page(i):
    return "Home | News\n" + body(i) + "\n\nMost read\n" + "\n".join(f"Entry {'abcdefgh'[i]} {'xy'[k]} with a title of seven words" for k in range(2)) + "\nAll rights reserved"


def test_frame_lines_go_and_the_body_stays(spark):
    known = [(f"n{i}", "s.example", f"https://s.example/a/{i}") for i in range(8)]
    data = [(f"p{i}", f"n{i}", page(i), None if i == 3 else markup(i), T0) for i in range(8)]
    got = mainbody.boilerplate_lines(pages(spark, data), nodes(spark, known)).collect()
    want = {(f"p{i}", n) for i in range(8) for n in (0, 5, 6, 7, 8)}
    assert {(r["id"], r["line_no"]) for r in got} == want and len(got) == len(want)


def test_without_markup_differencing_decides_alone(spark):
    known = [(f"n{i}", "s.example", f"https://s.example/a/{i}") for i in range(8)]
    data = [(f"p{i}", f"n{i}", page(i), None, T0) for i in range(8)]
    got = {(r["id"], r["line_no"]) for r in mainbody.boilerplate_lines(pages(spark, data), nodes(spark, known), html_col=None).collect()}
    # The prompt in the body is shared as well; nothing tells it from the frame. Entries go with the heading above their gap.
    assert got == {(f"p{i}", n) for i in range(8) for n in (0, 3, 5, 6, 7, 8)}


def test_entries_go_under_headings_of_any_tag(spark):
    known = [(f"n{i}", "s.example", f"https://s.example/a/{i}") for i in range(8)]
    for heading in ("<b>Most read</b>", "<p>Most read</p>", "<div>Most read</div>"):
        data = [(f"p{i}", f"n{i}", page(i), markup(i).replace("<aside><h3>Most read</h3>", f"<div class=x>{heading}").replace("</aside>", "</div>"), T0) for i in range(8)]
        got = {(r["id"], r["line_no"]) for r in mainbody.boilerplate_lines(pages(spark, data), nodes(spark, known)).collect()}
        assert got == {(f"p{i}", n) for i in range(8) for n in (0, 5, 6, 7, 8)}


def test_lists_above_the_title_leave_it(spark):
    known = [(f"n{i}", "s.example", f"https://s.example/a/{i}") for i in range(8)]
    text = lambda i: "Most read\n" + "\n".join(f"Entry {'abcdefgh'[i]} {'xy'[k]} with a title of seven words" for k in range(2)) + "\n" + body(i)
    got = {(r["id"], r["line_no"]) for r in mainbody.boilerplate_lines(pages(spark, [(f"p{i}", f"n{i}", text(i), None, T0) for i in range(8)]), nodes(spark, known)).collect()}
    assert got == {(f"p{i}", n) for i in range(8) for n in (0, 1, 2, 5)}


def test_borders_of_parts_have_no_influence(spark):
    # A line that only the first and last of nine pages share is met across any border; pages ten apart are not held together.
    known = [(f"n{i:02}", "s.example", f"https://s.example/{i:02}") for i in range(40)] + [("m", "t.example", None)]
    data = [(f"p{i:02}", f"n{i:02}", f"Own {i * 'x'}\nPair {'abcdefgh'[i % 8]}{'abcde'[i // 16]}\nFar {'abcdefghijklm'[i % 13]}", None, T0) for i in range(40)] + [("q", "m", "Pair aa", None, T0)]
    rows = [{tuple(r) for r in mainbody.boilerplate_lines(pages(spark, data), nodes(spark, known), parts=n).collect()} for n in (1, 3, 5)]
    assert rows[0] == rows[1] == rows[2] == {(f"p{i:02}", 1) for i in range(32)}


def test_thin_pages_lose_their_menus(spark):
    known = [(f"n{i}", "s.example", f"https://s.example/{i}") for i in range(4)]
    data = [(f"p{i}", f"n{i}", f"Home | News | Sport | Weather\nShort {'abcd'[i]}.\nAll rights reserved by the owner of these pages", None, T0) for i in range(4)]
    got = {tuple(r) for r in mainbody.boilerplate_lines(pages(spark, data), nodes(spark, known)).collect()}
    assert got == {(f"p{i}", n) for i in range(4) for n in (0, 2)}


def test_versions_of_one_article_are_not_differenced(spark):
    known = [(f"n{i}", "s.example", f"https://s.example/{i}") for i in range(2)]
    data = [(f"p{i}", f"n{i}", body(0) + f"\nVersion {i}", None, T0) for i in range(2)] + [("z", "n0", None, None, T0), (None, "n1", "x", None, T0)]
    assert mainbody.boilerplate_lines(pages(spark, data), nodes(spark, known)).count() == 0


def test_zones_of_markup():
    zones = mainbody.zones(markup(0))
    at = lambda text: zones.get(lines.key_of(lines.line_words(text)))
    assert at("Home | News") == mainbody.FRAME and at("Most read") == mainbody.FRAME and at("All rights reserved") == mainbody.FRAME
    assert at("Entry a x with a title of seven words") == mainbody.ENTRY and at(body(0).split("\n")[0]) == mainbody.BODY
    assert mainbody.zones("") == {} and mainbody.zones("<p>unclosed <b>bold") != {}
