import random

import pytest

from quillspark.operators import safety

PAGE, WIDTH = "page long, width double, height double, sureness double, allowed array<string>", 1000.0


def masks(spark, lines, sureness=0.6, allowed=None, height=2000.0):
    """rule: rectangles of one page; lines holds a text or (x, text) blocks for each visual line, forty apart."""
    words, n = [], 0
    for row, line in enumerate(lines):
        for x, text in [(0, line)] if isinstance(line, str) else line:
            if not text:
                continue
            words.append((1, n, text, float(x), 40.0 * row, x + 10.0 * len(text), 40.0 * row + 20))
            n += 1
    frame = spark.createDataFrame(words, "page long, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, WIDTH, height, sureness, allowed)], PAGE)
    out = {}
    for r in safety.safety_masks(frame, pages, "page").collect():
        out.setdefault(r["rule"], []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    return {k: sorted(v) for k, v in out.items()}


LETTER = ["Anna Willow", "12 High Street", "3 May 2020", "Phone: 07000000001", "Dear all", "We have asthma", "My son Tom Willow, who is 9", "Yours sincerely", "Anna Willow"]


def test_letter(spark):
    assert masks(spark, LETTER) == {
        "header": [(0, 0, 114, 21), (0, 39, 144, 61), (0, 119, 184, 141)],
        "label": [(59, 117, 186, 143)],
        "value": [(68, 118, 182, 142)],
        "sensitive": [(0, 197, 144, 223)],
        "dependent": [(67, 237, 173, 263)],
        "closing": [(0, 316, 116, 344)],
    }


def test_types_and_sureness_decide(spark):
    assert masks(spark, LETTER, allowed=["phone"]).keys() == {"header", "label", "value"}
    assert masks(spark, LETTER, allowed=[]).keys() == {"label", "value"}
    assert masks(spark, LETTER, allowed=["person_name"]) == {"header": [(0, 0, 114, 21)], "dependent": [(67, 237, 173, 263)], "closing": [(0, 316, 116, 344)]}
    assert masks(spark, LETTER, sureness=0.90) == {} and "form" not in masks(spark, LETTER, sureness=0.50)


def test_label_and_value_in_blocks_apart(spark):
    assert masks(spark, [[(0, "Name:"), (200, "A. Willow")], "x"])["label"] == [(49, 0, 296, 23)]


def test_hardly_readable_form(spark):
    found = masks(spark, ["Aamle Auynker", [(0, "fld"), (60, "="), (100, "abcdefgh")], "3 May 2020", "@dlyesS", "one", "two", "three", "four is a longer line of text"], sureness=0.49)["form"]
    assert found == [(0, 155, 38, 185), (0, 195, 38, 225), (0, 235, 58, 265), (58, 0, 138, 25), (73, 35, 188, 65)]
    below = masks(spark, ["a", "b", "c", "@dlyesS", "one long line of text that is no heading at all", "x" * 60], sureness=0.49)["form"]
    assert below == [(0, 155, 478, 185), (0, 195, 608, 225)]


def test_closing_stops_at_a_gap_and_wide_lines(spark):
    lines = ["Kind regards", "Bo", "", "", "", "Cy"]
    assert masks(spark, lines)["closing"] == [(0, 36, 26, 64)]
    assert "closing" not in masks(spark, ["signed", "a long line with many words that no one takes for a name"])


def test_a_word_of_the_text_is_no_label(spark):
    assert masks(spark, ["Are re be", "Re tion on"])["header"] == [(0, 0, 94, 21), (0, 39, 104, 61)]
    assert "header" not in masks(spark, ["Type: tion", "Dear all"])


def test_content_starts_at_a_subject(spark):
    assert masks(spark, ["Anna Willow", "Re: our talk", "12 High Street"])["header"] == [(0, 0, 114, 21)]


@pytest.mark.parametrize("seed", range(3))
def test_disjoint_covers_the_same_pixels(spark, seed):
    rng = random.Random(seed)
    boxes = []
    for page in range(4):
        for _ in range(rng.randrange(1, 9)):
            x, y = rng.randrange(30), rng.randrange(30)
            boxes.append((page, x, y, x + rng.randrange(0, 12), y + rng.randrange(0, 12)))
    boxes += boxes[:3]
    want = {(p, i, j) for p, a, b, c, d in boxes for i in range(a, c) for j in range(b, d)}
    got = [(r["page"], i, j) for r in safety.disjoint(spark.createDataFrame(boxes, "page long, x0 long, y0 long, x1 long, y1 long"), "page").collect() for i in range(r["x0"], r["x1"]) for j in range(r["y0"], r["y1"])]
    assert len(got) == len(set(got)) and set(got) == want
