"""Items of a page region: what each drawing is claimed by."""

import pytest

from gradeloom.operators import items as I

BOX = "page int, item int, id int, x0 double, y0 double, x1 double, y1 double, parts int, label string"
TEXT = "page int, item int, y double, x0 double, x1 double, text string"
LETTER = "page int, item int, letter string, x double, y double"


class Page:
    """Draws items from left to right; glyphs are 5 wide and 8 high."""

    def __init__(self):
        self.boxes, self.text, self.letters = [], [], []

    def box(self, item, x0, y0, x1, y1, label=None, parts=1):
        self.boxes.append((1, item, len(self.boxes), float(x0), float(y0), float(x1), float(y1), parts, label))

    def glyphs(self, item, x, y, said):
        for i, c in enumerate(said):
            self.box(item, x + 6 * i, y + 1, x + 6 * i + 5, y + 9, None if c == "#" else c)

    def say(self, item, y, x, text):
        self.text.append((1, item, float(y), float(x), x + 5.0 * len(text), text))


@pytest.fixture(scope="module")
def got(spark):
    p = Page()
    # a value in a gap, one at the line's end before a full stop, one that goes on past the bound
    p.say(1, 100, 80, "A farm sells berries for")
    p.glyphs(1, 204, 100, "$4")
    p.say(1, 100, 220, "a pound in")
    p.glyphs(1, 274, 100, "May")
    p.say(1, 100, 293, ".")
    p.say(1, 114, 80, "Ann spends")
    p.glyphs(1, 134, 114, "12345678")  # starts within reach, grows beyond it
    # a fraction whose bar is in the band, with pieces above and below
    p.say(1, 140, 80, "Take")
    p.box(1, 104, 144, 112, 144.6, "-")
    p.glyphs(1, 105, 131, "1")
    p.glyphs(1, 105, 146, "2")
    p.say(1, 140, 116, " of it.")
    p.say(1, 160, 80, "This question is worth 2 credits.")
    p.say(1, 174, 80, "Show your work.")
    # choices: a line, drawn maths, an unread block
    for i, c in enumerate("ABCD"):
        p.letters.append((1, 1, c, 75.0, 300.0 + 40 * i))
    p.say(1, 302, 90, "by adding")
    p.glyphs(1, 90, 340, "3x")
    p.glyphs(1, 90, 380, "7#")
    # another item: an unknown glyph in a hole, a displayed expression, a figure with its axis label, a frame
    p.say(2, 100, 80, "Let")
    p.glyphs(2, 98, 100, "#")
    p.say(2, 100, 106, "be a number.")
    p.glyphs(2, 150, 180, "y=3")
    p.box(2, 60, 90, 500, 700)
    for i in range(4):
        p.box(2, 100 + 50 * i, 300, 101 + 50 * i, 420)
        p.box(2, 100, 300 + 30 * i, 260, 301 + 30 * i)
    p.glyphs(2, 240, 350, "x")
    out = I.items(spark.createDataFrame(p.boxes, BOX), spark.createDataFrame(p.text, TEXT), spark.createDataFrame(p.letters, LETTER), "page", "item")
    return {name: df.collect() for name, df in out.items()}


def test_stems_and_holes(got):
    stems = {r["item"]: r for r in got["items"]}
    m = lambda t: f'<span class="math">{t}</span>'
    first = f"A farm sells berries for {m('$4')} a pound in {m('May')}. Ann spends {m('12345678')}"
    assert stems[1]["stem"].startswith(first) and stems[1]["credit_line"] == "This question is worth 2 credits." and stems[1]["unread"] == 0
    assert stems[2]["stem"] == f"Let {I.UNREAD} be a number." and stems[2]["unread"] == 1
    assert stems[1]["prose"].startswith("A farm sells berries fora pound in. Ann spends")
    bar = next(r for r in got["holes"] if r["item"] == 1 and r["y"] == 140)
    assert sorted(bar["text"]) == ["-", "1", "2"] and (bar["y0"], bar["y1"]) == (132.0, 155.0)


def test_choices_expressions_and_figures(got):
    choices = {r["letter"]: r["html"] for r in got["choices"]}
    assert choices == {"A": "by adding", "B": '<span class="math">3x</span>', "C": "", "D": ""}
    assert [(r["item"], r["html"]) for r in got["shown"]] == [(2, '<span class="math">y=3</span>')]
    assert [(r["item"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got["figures"]] == [(2, 100.0, 300.0, 260.0, 420.0)]


def test_each_drawing_is_claimed_once(got):
    said = [(r["item"], c) for r in got["holes"] for c in r["text"]]
    assert len(said) == len("$4May12345678") + 3
    assert {r["kind"] for r in got["lines"]} == {"stem", "credit", "instruction", "choice"}


def test_no_rows(spark):
    none = I.items(spark.createDataFrame([], BOX), spark.createDataFrame([], TEXT), spark.createDataFrame([], LETTER), "page", "item")
    assert all(df.count() == 0 for df in none.values())
