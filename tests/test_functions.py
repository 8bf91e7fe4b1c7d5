"""URL, text and entity functions."""

import pytest
from pyspark.sql import functions as F

from lorekeel.functions import entities, readability, text, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]




@pytest.mark.parametrize(("call", "given", "want"), [
    (urls.canonical, "https://A.Example/p?utm_source=x&b=2&gclid=1&a=1#top", "https://a.example/p?b=2&a=1"), (urls.canonical, "https://a.example", "https://a.example/"), (urls.canonical, "not a url", "not a url"), (urls.canonical, "https://a.example/?utm_term=q", "https://a.example/"),
    (urls.sanitised, "https://a.example/p?ref=1&source=2&utm_x=3&q=4", "https://a.example/p?q=4"), (urls.aggregation_key, "https://www.tokio.rs/tokio/tutorial", "tokio.rs/tokio"), (urls.aggregation_key, "https://tokio.rs/", "tokio.rs"), (urls.aggregation_key, "x", "x"),
    (urls.domain, "http://user@WWW.Example.com:8080/x", "example.com"), (urls.cache_key, "HTTP://Example.com:80/a/#x", "http://example.com/a"), (urls.cache_key, "https://e.com:443", "https://e.com"), (urls.cache_key, "https://e.com:444/", "https://e.com:444"),
    (urls.path_depth, "https://a.example/b//c/", 2), (urls.title_from_url, "https://a.example/x/my-first_page.html", "my first page"), (urls.title_from_url, "https://www.a.example/", "a.example"),
    (urls.redirect_target, "https://lite.example/l/?uddg=https%3A%2F%2Fb.example%2Fc%3Fd%3D1&rut=2", "https://b.example/c?d=1"), (urls.redirect_target, "https://www.search.example/ck/a?u=a1aHR0cHM6Ly9iLmV4YW1wbGUvYw&p=1", "https://b.example/c"), (urls.redirect_target, "https://a.example/x", "https://a.example/x"),
    (urls.is_safe, "http://192.168.0.1/", False), (urls.is_safe, "https://example.com/", True), (urls.is_safe, "ftp://example.com/", False), (urls.is_safe, None, False), (urls.is_safe, "http://localhost:80/", False),
])
def test_urls(spark, call, given, want):
    assert one(spark, call(F.col("u")), u=given) == want


def test_suffixes(spark):
    assert one(spark, urls.root_domain(F.col("u")), u="a.b.gov.uk") == "b.gov.uk"
    assert one(spark, urls.root_domain(F.col("u")), u="a.b.example") == "b.example"
    assert one(spark, urls.public_suffix(F.col("u")), u="x.ac.uk") == "ac.uk"


@pytest.mark.parametrize(("call", "given", "want"), [
    (text.word_count, " a  b\nc ", 3), (text.word_count, None, 0), (text.tokens, "Déjà vu, 2x!", ["déjà", "vu", "2x"]), (text.keywords, "What is the BEST async runtime in 2024, async Rust?", ["async", "runtime", "rust"]), (text.keywords, "", []),
    (text.quoted_terms, 'a "Exact Phrase" “two”', ["exact phrase", "two"]), (text.match_expression, "foo: bar-baz (qux)", '"foo" "bar-baz" "qux"'), (text.without_scripts, "a<script>var x='</p>'</script> <!-- c --> b", "a b"), (text.visible_text, "<p>A &amp; B</p><style>p{}</style>", "A & B"),
    (text.html_escaped, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"), (text.without_snippet_date, "Jan 15, 2025 - New things", "New things"), (text.without_snippet_date, "3 days ago · More", "More"), (text.byte_size, "10GB", 10 * 1024**3), (text.byte_size, "1.5 k", 1536), (text.byte_size, "x", None),
    (text.split_commas, "a, b,,c ", ["a", "b", "c"]), (text.boilerplate_cut, "Body text. Was this helpful? more", "Body text."), (text.boilerplate_cut, "Was this helpful? first", "Was this helpful? first"), (text.excerpt, "Short one. This sentence has at least eight words in it. End.", "This sentence has at least eight words in it."),
    (text.is_unsafe_text, "An NSFW guide", True), (text.is_unsafe_text, None, False), (text.looks_like_prose, "The cat sat on the mat and slept there all day.", True), (text.looks_like_prose, "function a() { var x = 1; const y = () => x; }", False), (text.looks_like_css, ".a{color:red;} .b{margin:0;}", True), (text.token_estimate, "abcde", 2),
])
def test_texts(spark, call, given, want):
    assert one(spark, call(F.col("u")), u=given) == want


def test_relaxation_shortens_and_keeps_a_word(spark):
    assert [one(spark, text.relaxed(F.col("u"), n), u="a b c") for n in range(5)] == ["a b c", "a b", "a", "a", "a"]


def test_shingles(spark):
    assert one(spark, text.shingles(F.col("u"), 3), u=["a", "b", "c", "d"]) == ["a b c", "b c d"]
    assert one(spark, text.shingles(F.col("u"), 3), u=["a", "b"]) == []
    assert one(spark, text.shingles(F.col("u"), 1), u=["a"]) == ["a"]


def test_keyword_matches(spark):
    call = text.keyword_matches(F.col("k"), F.col("t"), F.col("s"))
    assert one(spark, call, k=["async"], t="asynchronous code", s="") == 1
    assert one(spark, call, k=["cve-2024-3094", "e0308"], t="About CVE-2024-3094", s="error E0308") == 4
    assert one(spark, call, k=["zig"], t="rust", s=None) == 0


def test_snippet_dates(spark):
    at = F.lit("2025-06-10 00:00:00").cast("timestamp")
    day = lambda s: str(one(spark, text.snippet_date(F.col("u"), at), u=s))[:10]
    assert [day(s) for s in ("2025-01-15 · x", "Jan 5, 2025 - y", "3 days ago", "2 months ago - z", "none")] == ["2025-01-15", "2025-01-05", "2025-06-07", "2025-04-11", "None"]


@pytest.mark.parametrize(("slot", "given", "want"), [
    ("email", "A.b@c.example, a.B@C.example and x@y.org", ["A.b@c.example", "x@y.org"]), ("version", "v1.2.3 and 1.2.3-rc1", ["v1.2.3", "1.2.3-rc1"]), ("price", "costs $5.00 or €1,200.50", ["$5.00", "€1,200.50"]), ("ip", "10.0.0.1 999.1.1.1", ["10.0.0.1", "99.1.1.1"]), ("date", "on 2024-01-02 or 3 March 2024", ["2024-01-02", "3 March 2024"]),
    ("license", "under the MIT license", ["MIT license"]), ("handle", "by @some_one", ["@some_one"]), ("tex", "so $a^2$ holds", ["$a^2$"]), ("repository", "see https://github.com/a/b now", ["https://github.com/a/b"]), ("phone", "call +1 (555) 123-4567", ["+1 (555) 123-4567"]),
])
def test_entities(spark, slot, given, want):
    assert one(spark, entities.entity(F.col("u"), slot), u=given) == want
    assert one(spark, entities.entity(F.col("u"), slot), u=None) == []


def test_only_maths_is_capped(spark):
    given = {"email": "u{}@c.example", "phone": "+1 555 123-4{:03d}", "url": "https://a.example/{}", "version": "1.2.{}", "price": "$1{:03d}.00", "date": "{}-01-02", "ip": "10.0.{}.1", "handle": "@user{}"}
    for slot, form in given.items():
        numbers = range(1000, 1300) if slot == "date" else range(250) if slot == "ip" else range(300)
        want = [form.format(n) for n in numbers]
        assert one(spark, entities.entity(F.col("u"), slot), u=" , ".join(want)) == want, slot
    assert len(one(spark, entities.entity(F.col("u"), "tex"), u=" , ".join(f"$a^{n}$" for n in range(300)))) == 200


def test_readability(spark):
    easy, hard = "The cat sat. The dog ran.", "Institutional considerations necessitate comprehensive multidisciplinary investigations."
    rows = spark.createDataFrame([(easy,), (hard,), ("a b",), (None,)], "u string").select(readability.readability("u").alias("r")).collect()
    assert rows[0]["r"]["ease"] > 90 > 0 > rows[1]["r"]["ease"] and rows[2]["r"]["ease"] is None and rows[3]["r"]["words"] == 0
    assert one(spark, readability.quality(F.lit(None).cast("double"), F.lit(None).cast("double")), u="") == 0.5


def test_hash_embedding_has_unit_length():
    v = readability.hash_vector("some text")
    assert len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-9 and readability.hash_vector("") == [0.0] * 32


def test_unicode_forms(spark):
    assert one(spark, readability.nfc(F.col("u")), u="é") == "é" and one(spark, readability.nfkc(F.col("u")), u="ﬁ") == "fi" and one(spark, readability.nfc(F.col("u")), u=None) is None
