import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from hearthgauge.llm import html_text, license_scan

LEAST = license_scan.DICE_LEAST
SHORT = [t for t in license_scan.TEMPLATES if len(license_scan.normal_words(t[1])) < 40][:6]


def bigrams(words):
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_within(text):
    """Licence -> best coefficient of windows that no overlapping window beats."""
    out = {}
    for piece in re.split("\n[\x20\x09-\x0d]*\n", text):
        grams, windows = bigrams(license_scan.normal_words(piece)), []
        for name, template in license_scan.TEMPLATES:
            own = Counter(bigrams(license_scan.normal_words(template)))
            size = sum(own.values())
            for start in range(len(grams)):
                if grams[start] in own:
                    dice = sum((Counter(grams[start : start + size]) & own).values()) / size
                    if dice >= LEAST:
                        windows.append((-dice, name, start, start + size))
        for w in windows:
            if not any(x[2] < w[3] and w[2] < x[3] and x[:2] < w[:2] for x in windows):
                out[w[1]] = max(out.get(w[1], 0), -w[0])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_notices_within_equal_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(40):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            words = license_scan.normal_words(rng.choice(license_scan.TEMPLATES)[1])
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["the", "license", "zzz"])
            a = rng.randrange(3)
            parts.append(" ".join(words[a : len(words) - rng.randrange(3)]))
            parts.append(" ".join(rng.choice("some other words of prose stand here".split()) for _ in range(rng.randrange(8))))
        rows.append((k, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = license_scan.template_bigrams()
    keyed = df.selectExpr("doc_id", "text", "xxhash64(text) AS text_key")
    got = license_scan.notices_within(keyed, license_scan.template_table(spark, grams), grams, LEAST).collect()
    assert {(r.doc_id, r.license): round(r.dice, 9) for r in got} == {(k, name): round(d, 9) for k, t in rows for name, d in brute_within(t).items()}
    assert len({r.license for r in got}) > 5


def test_many_notices_in_a_line_take_time_in_proportion(spark):
    name, text = SHORT[0]
    took = {}
    for n in (50, 400, 3200):
        df = spark.createDataFrame([(1, " ".join(["words " + text.replace("\n", " ")] * n))], "doc_id long, text string")
        began = time.perf_counter()
        row = license_scan.scan_licenses(df).first()
        took[n] = time.perf_counter() - began
        assert name in row.licenses
    assert took[3200] < 12 * took[400]


ARTICLE = "<article><p>" + "Long words of an article. " * 20 + "</p>{}</article>"
FIRST = " ".join(["Long words of an article."] * 20)


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<p title="A hidden gem">gem</p>', True),
        ('<div data-note="was hidden before">gem</div>', True),
        ('<section aria-label="Side effects and share prices"><p>gem</p></section>', True),
        ('<section class="side-effects">gem</section>', True),
        ("<p data-x='display:none'>gem</p>", True),
        ("<p hidden>gem</p>", False),
        ('<p HIDDEN="">gem</p>', False),
        ('<p style="color:red; display : none">gem</p>', False),
        ('<p aria-hidden="true">gem</p>', False),
        ('<div class="related-widget">gem</div>', False),
        ('<section aria-label="Comments">gem</section>', False),
    ],
)
def test_attributes_are_read_as_names_and_values(part, kept):
    assert html_text.main_text(ARTICLE.format(part)) == (FIRST + " gem" if kept else FIRST)
