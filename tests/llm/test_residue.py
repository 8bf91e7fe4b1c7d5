"""Template residue."""

from datetime import datetime

import pytest

from lorekeel.llm import residue

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
PROSE = "The museum keeps its opening hours until the spring, and the local paper reports the ticket numbers.\nNobody asks why the ferry company counts every crate twice a week."
BAD = {
    "placeholder": ["Dear {{ customer.name }}, welcome.", "${article.text}", "[Headline goes here]", "XXX-CITY-XXX is open", "__NAME_VALUE__", "%TITLE%", "@@date@@ in town", "<%= body.text %>", "[[date_label]]", "The #{headline} report", "undefined", "[CITY LABEL HERE]"],
    "error": ["404 – Page not found", "SORRY, WE COULD NOT OPEN THIS PAGE.", "Une erreur est survenue. La demande 12 n'a pas abouti.", "Fehler 403: Seite nicht gefunden", "Example Notes is down for maintenance. We expect to be back in 3 minutes.", "Application exception: NullReference at a.render (b.py:12)"],
    "access": ["Access denied. You have no permission to view /a/b on this server. Reference 9.", "Checking your connection … one moment please.", "Loading, please wait …"],
    "script": ["This page needs JavaScript. Switch scripts on in your browser and load Example again.", "Activez JavaScript pour lire Exemple."],
    "filler": ["Lorem ipsum dolor sit amet, minim veniam culpa pulvinar sed magna.", "Tempor adipiscing sint sint adipiscing dolor culpa amet duis."],
}
#: Share of the exemplars that the others tell, at least; few words of one message stand in others.
HELD_OUT = 0.2
GOOD = [
    PROSE, "", None, 'The handbook explains what "404 – Page not found" means and how often the clerk sees it.', 'Many readers see "please enable JavaScript" and leave; nobody minds.', 'Typesetters put "lorem ipsum" where the text will stand.',
    "In the template language, {{ author.name }} stands for a value that the clerk fills in later.", "Dans le langage des gabarits, #{title} désigne une valeur, et le musée la remplit.", "The reason is unknown.", "A price of $5 {at most} was not found on this page of the book.",
]


def df(spark, data):
    return spark.createDataFrame([(i, t, e, at, "x", "y", 1) for i, t, e, at in data], "id string, content_text string, excerpt string, created_at timestamp, kind string, t0 string, tie int")


@pytest.fixture(scope="module")
def result(spark):
    data = [(f"{kind}{n}", f"{PROSE}\n{t}\n{PROSE}" if n % 2 else t, None, T0) for kind, texts in BAD.items() for n, t in enumerate(texts)]
    data += [(f"good{n}", t, t, T0) for n, t in enumerate(GOOD)] + [(f"prose{n}", PROSE, "", T0) for n in range(200)]
    data += [("excerpt", PROSE, "{{ page.title }}", T0), ("late", "undefined", None, T0), ("late", PROSE, None, T1), ("twice", "undefined", None, T0), ("twice", "undefined", None, T0), (None, "undefined", None, T0)]
    return {r["id"]: (r["column"], r["kind"]) for r in residue.residue(df(spark, data)).collect()}


def test_all_residue_is_found(result):
    for kind, texts in BAD.items():
        for n, text in enumerate(texts):
            assert result.get(f"{kind}{n}", (None, None))[1] == kind, text


def test_mentions_quotations_and_prose_are_not(result):
    assert [GOOD[n] for n in range(len(GOOD)) if f"good{n}" in result] == []
    assert not any(i.startswith("prose") for i in result)


def test_columns_deliveries_and_nulls(result):
    assert result["excerpt"] == ("excerpt", "placeholder") and "late" not in result and "twice" in result and None not in result


def test_exemplars_left_out_are_found_by_the_others():
    # Each message of three content words or more is taken out of the index and must be told by those that are left.
    told = tried = 0
    for language, kinds in residue.EXEMPLARS.items():
        for kind, texts in kinds.items():
            for text in texts:
                if kind == "filler" or len(residue.stems_of(residue.words_of(text))) < 4:
                    continue
                rest = {lang: {k: [t for t in ts if t != text] for k, ts in ks.items()} for lang, ks in residue.EXEMPLARS.items()}
                index = residue.Index(rest, dict.fromkeys(residue.vocabulary(rest), 20), 10_000, residue.Rules())
                tried += 1
                told += residue.kind_of(text, index) is not None
    assert tried >= 60 and told >= HELD_OUT * tried, (told, tried)


@pytest.mark.parametrize(
    "text",
    [
        "This content is currently unavailable. Please check back soon.", "Turn on JavaScript in your browser settings to use this website.", "Die angeforderte Seite existiert nicht.", "Contenu indisponible pour le moment.", "Sample text. Replace me.",
        "Oops! We can't find the page you requested.", "Please verify you are a human.", "Bitte aktivieren Sie JavaScript, um die Seite zu nutzen.", "Se ha producido un error. Inténtelo de nuevo más tarde.",
    ],
)
def test_messages_worded_in_other_ways(text):
    index = residue.Index(residue.EXEMPLARS, dict.fromkeys(residue.vocabulary(residue.EXEMPLARS), 20), 10_000, residue.Rules())
    assert residue.kind_of(text, index)


def test_empty_table_and_long_text(spark):
    assert residue.residue(df(spark, [])).count() == 0
    found = residue.residue(df(spark, [("a", (PROSE + "\n") * 5000 + "Loading, please wait …", None, T0), ("b", "word " * 200_000, None, T0)])).collect()
    assert [r["id"] for r in found] == ["a"]


def test_filler_is_found_however_frequent_it_is(spark):
    for third in (1, 40):
        data = [(f"filler{n}", f"{PROSE}\n{BAD['filler'][n % 2]}", None, T0) for n in range(third)] + [(f"prose{n}", PROSE, "", T0) for n in range(2 * third)]
        assert {r["id"] for r in residue.residue(df(spark, data)).collect()} == {f"filler{n}" for n in range(third)}


def test_words_of_living_languages_are_no_filler(spark):
    data = [("a", "Integer massa, non est odio; et qui dolor in culpa ex sed do eu.", None, T0), ("b", PROSE, None, T0)]
    assert residue.residue(df(spark, data)).count() == 0


def test_exclusion(spark):
    data = df(spark, [("a", "undefined", None, T0), ("b", PROSE, None, T0)])
    assert [r["id"] for r in residue.without_residue(data, residue.residue(data)).collect()] == ["b"]
