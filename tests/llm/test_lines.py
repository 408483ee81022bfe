"""Near lines that share a template, and short lines."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def lines_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    line = F.col("text").cast("binary")
    return df.select("id", line.alias("line"), line_dedup.letter_counts(line).alias("counts"), line_dedup.digit_counts(line).alias("digits"))


def edited(rng, text):
    text = list(text)
    for _ in range(rng.randint(0, 2)):
        kind, at = rng.randint(0, 2), rng.randrange(len(text))
        if kind == 0:
            text[at] = rng.choice("0123456789ab")
        elif kind == 1:
            text.insert(at, rng.choice("0123456789ab"))
        else:
            del text[at]
    return "".join(text)


@pytest.mark.parametrize("crowd", [3, 100_000])
def test_template_lines_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(1)
    texts = [f"Posted on 20{rng.randint(10, 12)}-0{rng.randint(1, 3)}-{rng.randint(10, 13)} by the é site team" for _ in range(60)]
    texts += ["Price: %d EUR, all taxes included" % rng.randint(1, 3000) for _ in range(40)]
    texts += ["no digit in this line of the footer", "no digit in this line of the header"]
    texts = sorted({edited(rng, t) for t in texts + texts})
    found = {(r.a, r.b, r.edits) for r in line_dedup.near_lines(lines_of(spark, texts), 2).collect()}
    want = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if i < j and (d := distance(a.encode(), b.encode())) <= 2:
                want.add((*((i, j) if len(a.encode()) <= len(b.encode()) else (j, i)), d))
    assert found == want and len(want) > 30


def test_candidates_of_a_template_stay_few(spark, monkeypatch):
    """Lines that differ in their digits only are not compared all with all."""
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = sorted({f"Posted on {digits(4)}-{digits(2)}-{digits(2)} at {digits(2)}:{digits(2)} by the site admin team" for _ in range(4000)})
    written = {}
    keep = line_dedup.materialise

    def counted(df, name="table"):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(line_dedup, "materialise", counted)
    line_dedup.near_lines(lines_of(spark, texts), 2).count()
    assert written["crowded"].count() > 0
    assert written["pairs"].count() < 4 * len(texts)


def test_short_lines_go_for_equal_ones_only(spark):
    rows = [(1, "Home\nShare on it\n \n"), (2, "Share on it\nShare on at\n \n"), (3, "Home")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.removed for r in line_dedup.repeated_lines(df, equal_bytes=1).collect()}
    assert found == {1: [], 2: [0], 3: [0]}
    assert all(r.removed == [] for r in line_dedup.repeated_lines(df).collect())
