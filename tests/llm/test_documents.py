"""Languages, leaks and truncation of documents."""

import random
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeel.llm import langid, leakage, truncation

TABLES = "/root/testdata/sf0.001"
SAMPLES = {
    "en": "The council meets in the old town hall and the members speak about the new bridge. Nobody knows when the work will begin, but the river is high and the boats cannot pass. We have read the report that was sent to all the people of the district.",
    "de": "Der Rat trifft sich im alten Rathaus und die Mitglieder sprechen über die neue Brücke. Niemand weiß, wann die Arbeit beginnen wird, aber der Fluss ist hoch und die Schiffe können nicht fahren. Wir haben den Bericht gelesen, der an alle Leute im Bezirk geschickt wurde.",
    "fr": "Le conseil se réunit dans la vieille mairie et les membres parlent du nouveau pont. Personne ne sait quand les travaux commenceront, mais la rivière est haute et les bateaux ne peuvent pas passer. Nous avons lu le rapport qui a été envoyé à tous les gens du quartier.",
    "ru": "Совет собирается в старой ратуше, и члены говорят о новом мосте. Никто не знает, когда начнётся работа, но река высокая и лодки не могут пройти. Мы прочитали отчёт, который был отправлен всем людям района.",
}
EN = "The members of the council speak about the bridge and nobody knows when the boats will pass."
DE = "Die Mitglieder sprechen über die Brücke und niemand weiß, wann die Schiffe fahren werden."
CODE = "for (i = 0; i < 10; i++) { xq_9 += zz[i] }"


def lang_rows(spark, data):
    docs = spark.createDataFrame([(i, t, label, "x", "y", 1) for i, t, label in data], "doc_id long, content_text string, language string, lang string, main string, words int")
    samples = spark.createDataFrame([(n, lang, s) for n, (lang, text) in enumerate(SAMPLES.items()) for s in text.split(". ")] + [(99, None, "x"), (98, "en", None)], "sample_id long, lang string, text string")
    return langid.languages(docs, samples)


def test_documents_and_lines_get_languages(spark):
    data = [(1, f"{EN}\n\n{DE}\n{EN} {EN}", "en-GB"), (2, DE, None), (3, DE, "deutsch"), (4, DE, "English"), (5, CODE + "\n12 34 56", "en"), (6, None, "en"), (7, "", ""), (8, " \n ", "xx"), (8, EN, "??"), (8, EN, "??")]
    found = lang_rows(spark, data)
    assert {(r["doc_id"], r["seg_no"]): r["lang"] for r in found.collect() if r["doc_id"] < 5} == {(1, -1): "en", (1, 0): "en", (1, 2): "de", (1, 3): "en", (2, -1): "de", (2, 0): "de", (3, -1): "de", (3, 0): "de", (4, -1): "de", (4, 0): "de"}
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3, 4, 8}
    assert all(0 < r["confidence"] <= 1 for r in found.collect())
    assert {tuple(r) for r in langid.mislabelled(found).collect()} == {(1, 2, "de"), (2, -1, "de"), (4, -1, "de"), (8, -1, "en")}
    assert langid.mislabelled(found).count() == 4


@pytest.mark.skipif(not Path(TABLES).exists(), reason="the given tables are not here")
def test_held_out_accuracy_on_given_samples(spark):
    samples = spark.read.parquet(f"{TABLES}/language_samples.parquet")
    held = samples.filter("sample_id % 3 = 0").selectExpr("sample_id as doc_id", "text as content_text", "lang as language")
    found = langid.languages(held, samples.filter("sample_id % 3 <> 0")).filter("seg_no = -1")
    right = found.filter("lang = label_names").count()
    assert right >= 0.99 * held.count()


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), (" de_AT", "de"), ("español", "es"), ("fra", "fr"), ("und", None), ("", None), (None, None), ("??", None), ("pt-BR", "pt"), ("uk", None)])
def test_labels(label, code):
    assert langid.named_language(label) == code


def test_samples_are_bounded_for_each_language(spark):
    samples = spark.createDataFrame([(n, lang, "word " * 10) for n in range(40) for lang in ("en", "zz")] + [(99, "la", "verba"), (None, None, "x"), (100, "en", None)], "sample_id long, lang string, text string")
    got = langid.samples_of(samples, 120)
    assert {lang: len(texts) for lang, texts in got.items()} == {"en": 3, "zz": 3, "la": 1}


def test_no_documents_no_samples(spark):
    assert lang_rows(spark, []).count() == 0
    docs = spark.createDataFrame([(1, EN, "en")], "doc_id long, content_text string, language string")
    assert langid.languages(docs, spark.createDataFrame([], "sample_id long, lang string, text string")).count() == 0


VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa", "te") for b in ("bat", "cor", "dun", "fel", "gim", "hos")]


def passage(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) + str(rng.randrange(3)) * 0 for _ in range(n)]


ITEMS = [(i, "s", "en", "Read this and answer now: " + " ".join(passage(i)) + ".", f"answer {VOCABULARY[i]}") for i in range(1, 6)]


def leaks(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, item_id string, share int")
    rows = spark.createDataFrame([(*item, 0) for item in items], "item_id long, suite string, lang string, text string, answer string, id int")
    return leakage.leaked_items(docs, rows)


def test_whole_partial_and_edited_passages(spark):
    filler = " ".join(passage(77, 80))
    p = passage(2)
    changed = [w if n % 11 else "other" for n, w in enumerate(p)]
    texts = [
        (1, f"{filler} {' '.join(passage(1))} {filler}"), (2, " ".join(changed).upper()), (3, f"{filler}. «{' '.join(p[5:20])}»\n> {filler}\n{' '.join(p[30:45])}"), (4, " ".join(p[:15])), (5, "Read this and answer now:"),
        (6, filler), (7, None), (8, ""), (9, "\n> ".join([" ".join(p[:20]), " ".join(p[20:40])])), (10, " ".join(passage(1) + passage(4))), (10, " ".join(passage(1) + passage(4))), (11, " ".join(reversed(p))),
    ]
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(spark, texts).collect())
    assert got == [(1, 1), (2, 2), (3, 2), (9, 2), (10, 1), (10, 1), (10, 4), (10, 4)]


def test_offsets_point_into_the_original(spark):
    text = "Ünïcode — start. «" + " ".join(passage(3)).title() + "» end; answer " + VOCABULARY[3]
    row = leaks(spark, [(1, text)]).first()
    assert text[row["start"] : row["end"]] == " ".join(passage(3)).title() and row["share"] == 1.0 and row["answer_seen"]


def test_no_items_no_documents(spark):
    assert leaks(spark, []).count() == 0
    assert leaks(spark, [(1, "a b c")], [(1, "s", "en", None, None)]).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 5), st.integers(20, 40), st.integers(0, 40))
def test_any_long_enough_run_is_found(seed, length, start):
    items = [{"item_id": 1, "suite": "a", "text": " ".join(passage(9, 48)), "answer": None}]
    matcher = leakage.Matcher(items)
    start = min(start, 48 - length)
    text = " ".join(passage(200 + seed, 30) + passage(9, 48)[start : start + length] + passage(300 + seed, 30))
    assert [f[0] for f in matcher.found(text)] == [1]


def test_short_passages_count_with_their_answers(spark):
    items = [(1, "s", "en", "Read now: who keeps the lamp?", "the old miller"), (2, "s", "en", "Read now: where is it?", None), (3, "s", "en", None, "x"), (4, "s", "en", "Read now: " + " ".join(passage(4)), "a b")]
    texts = [(1, "Well. WHO KEEPS the lamp?\n- The old miller!"), (2, "Who keeps the lamp? " + "no " * 50 + "the old miller"), (3, "the old miller. Who keeps the lamp?"), (4, "Where is it?")]
    got = leaks(spark, texts, items).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"], texts[0][1][r["start"] : r["end"]]) for r in got] == [(1, 1, "answer", texts[0][1][6:-1])]
    rows = spark.createDataFrame([(*item, 0) for item in items], "item_id long, suite string, lang string, text string, answer string, id int")
    assert leakage.unsearchable(rows) == [2, 3]


def test_one_item_may_begin_with_another(spark):
    items = [(1, "s", "en", " ".join(passage(1, 30)), None), (2, "s", "en", " ".join(passage(1, 30) + passage(2, 30)), None)]
    got = leaks(spark, [(1, " ".join(passage(1, 30)))], items).collect()
    assert {r["item_id"] for r in got} == {1, 2}


def test_repeated_phrases_stay_linear():
    words = passage(5, 400)
    matcher = leakage.Matcher([{"item_id": 1, "suite": "a", "text": " ".join(words), "answer": None}])
    text = " ".join(words[100:112] * 20_000)
    began = time.perf_counter()
    assert matcher.found(text) == []
    assert time.perf_counter() - began < 20


def corpus(n, seed=1):
    rng = random.Random(seed)
    sentence = lambda: (" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 14))) + ".").capitalize()
    ends = [lambda: "", lambda: "\n– " + " ".join(rng.choice(VOCABULARY) for _ in range(2)), lambda: "\nhttps://a.example/" + str(rng.randrange(99)), lambda: "\n#" + rng.choice(VOCABULARY) + " #" + rng.choice(VOCABULARY)]
    return ["\n".join(" ".join(sentence() for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(2, 5))) + ends[rng.randrange(4)]() for _ in range(n)]


def truncations(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "src", True, 1) for i, t in texts], "doc_id long, text string, lang string, source string, marked boolean, e3 int")
    return truncation.truncated(df, keep=("source",))


def test_held_out_cuts_are_found(spark):
    rng = random.Random(4)
    texts, cut = [], set()
    for n, text in enumerate(corpus(600)):
        if n % 6 == 0:
            at = rng.randrange(len(text) // 2, len(text) - 3)
            while text[at - 1] in ".\n –#" or text[at] in ".\n" or text.rfind("\n", 0, at) + 3 > at or text[text.rfind("\n", 0, at) + 1] in "–#h":
                at -= 1
            text, _ = text[:at] + ["", "…", " [...]", "&am"][n // 6 % 4], cut.add(n)
        texts.append((n, text))
    got = {r["doc_id"] for r in truncations(spark, texts).filter("cut").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.01 * len(texts)


def test_blank_texts_are_complete_and_shares_are_by_source(spark):
    texts = [(n, t) for n, t in enumerate(corpus(60))] + [(100, None), (101, ""), (102, " \n"), (103, "…"), (104, "Kabat lodun…"), (104, "Kabat lodun…")]
    found = truncations(spark, texts)
    assert sorted(r["doc_id"] for r in found.filter("cut").collect()) == [104, 104]
    row = truncation.truncation_by_source(found).first()
    assert (row["source"], row["texts"], row["cut"]) == ("src", 62, 2)
    assert truncations(spark, []).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .\n–#,", max_size=30), min_size=1, max_size=4))
def test_contexts_agree_with_a_plain_reading(texts):
    ends, _, found, counts = truncation.contexts("\0".join(texts))
    shapes = {"a": 1, "B": 2, "1": 3, ".": 4, "–": 9, "#": 12, ",": 6}
    want = []
    for text in texts:
        for line in text.split("\n"):
            run = []
            previous = ""
            for c in line:
                kind = "L" if c in "aB" else "D" if c == "1" else c
                if c != " " and not (kind in "LD" and kind == previous):
                    run.append(shapes[c])
                previous = kind if c != " " else ""
            for n in range(len(run)):
                before = [15, *run[: n + 1]][-3:]
                want.append((n == len(run) - 1, sum(v << (4 * k) for k, v in enumerate(reversed(before)))))
    three = found[truncation.ORDERS.index(3)]
    got = [(bool(e), int(c)) for e, c, u in zip(ends, three, counts, strict=True) if u]
    # The first line of all has nothing before it; there the start mark fills the context.
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] & 0xF == w[1] & 0xF for g, w in zip(got, want, strict=True))
