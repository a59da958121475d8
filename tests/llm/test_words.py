import pytest

pytest.importorskip("quadloom.llm")

from quadloom.llm.words import Numbered, fold, visible, words_of  # noqa: E402

WANT = ["the", "creme", "brulee", "of", "2024", "wins"]


@pytest.mark.parametrize(
    "text",
    [
        "The crème brûlée of 2024 wins",
        "THE CRÈME BRÛLÉE OF 2024 WINS!",
        "The crème brûlée of ２０２４ wins",
        "<p>The <b>crème</b> brûlée&nbsp;of <a href='x'>2024</a></p>\n<p>wins</p>",
        "The crè­me brû​lée of 2024 wins",
        "> The crème brû-\n> lée of 2024\n> wins",
        "The crème brû‐\r\nlée — of\t«2024» wins<sup>[3]</sup>",
        "The c<b>rè</b>me brûlée of 2024 wins <!-- not -->",
    ],
)
def test_forms(text):
    assert words_of(text) == WANT


def test_code_of_any_length_is_no_text():
    code = "var word = 1;\n" * 500
    assert words_of(f"The crème<script type='x'>{code}</script> brûlée <STYLE>{code}</STYLE>of 2024 wins") == WANT
    assert len(words_of("<sup>" + "word " * 200 + "</sup>")) == 200


def test_nothing():
    assert words_of(None) == words_of("") == words_of(" ​<br/>") == []


def test_numbers():
    number = Numbered({w: i for i, w in enumerate(WANT)}, keep=2)
    assert number("The crème BRÛLÉE xyz the") == [0, 1, 2, -1, 0]
    assert number(None) == []


def test_fold_and_visible():
    assert fold("Straße ÉCLAIR") == "strasse eclair"
    assert visible("a < b and c > d") == "a < b and c > d"
    assert len(visible("x" * 1_000_000)) == 1_000_000
