import random
import re
import time

from pyspark.sql import functions as F

from hearthgauge.llm import columns, personal_data


def brute(text, spans):
    out, end = "", 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"], s["kind"])):
        if s["start"] >= end:
            out += text[end : s["start"]] + f"<{s['kind']}>"
        end = max(end, s["end"])
    return out + text[end:]


def test_redacted_texts_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    found = ["a.b@example.org", "10.0.0.1", "4111 1111 1111 1111", "+44 20 7946 0958", "x+4420794609581@10.0.0.1.org", "é🙂"]
    for k in range(60):
        rows.append((k, " ".join(rng.choice([*found, "word", "ümlaut 🙂", "z" * rng.randrange(9000)]) for _ in range(rng.randrange(40)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in personal_data.find_personal_data(df).collect()}
    got = {r.doc_id: r.text for r in personal_data.redact(df).collect()}
    assert got == {k: brute(t, spans[k]) for k, t in rows} and any("<email>" in t for t in got.values())


def test_blocks_give_back_any_part(spark):
    text, rng = "aé🙂" * 50, random.Random(1)
    cuts = sorted((rng.randrange(151), rng.randrange(151)) for _ in range(200))
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a long, b long")
    for block in (1, 7, 150, 1000):
        part = columns.let(columns.in_blocks(F.col("text"), block), lambda x: columns.cut_out(x, block)(F.col("a"), F.col("b")))  # noqa: B023
        assert [r[0] for r in df.select(part).collect()] == [text[a:b] if b > a else "" for a, b in cuts]
    numbers = [3, 1, 4, 1, 5, 9, 2, 6]
    row = spark.createDataFrame([(numbers,), ([],)], "x array<int>").select(columns.running_max(F.col("x"), 3), columns.running_sums(F.col("x"), 3)).collect()
    assert [*map(list, row)] == [[[0, 3, 3, 4, 4, 5, 9, 9], [0, 3, 4, 8, 9, 14, 23, 25]], [[], []]]


def test_time_grows_with_the_spans(spark):
    took = {}
    for n in (2_000, 16_000):
        df = spark.createDataFrame([(1, " ".join(f"write to name{k}@example.org now." for k in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        text = personal_data.redact(df).first().text
        took[n] = time.perf_counter() - began
        assert len(re.findall("<email>", text)) == n
    assert took[16_000] < 16 * took[2_000]
