"""Bit-parallel distances against the table."""

import random
import time

from caselink.functions.distance import edit_distance
from caselink.operators import metrics


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_equals_the_table():
    r = random.Random(1)
    for _ in range(3000):
        k = r.choice([2, 4, 26])
        a, b = ("".join(chr(97 + r.randrange(k)) for _ in range(r.randrange(0, r.choice([3, 12, 90, 200])))) for _ in "ab")
        if r.random() < 0.5:
            b = "".join(c for c in a if r.random() > 0.1) + b[: r.randrange(3)]
        assert edit_distance(a, b) == edit_distance(b, a) == edit_distance(list(a), list(b)) == table(a, b), (a, b)


def test_long_texts():
    r = random.Random(2)
    a = "".join(chr(97 + r.randrange(26)) for _ in range(100_000))
    b = list(a)
    for i in range(0, 100_000, 100):
        b[i] = "#"
    began = time.process_time()
    assert edit_distance(a, "".join(b)) == 1000
    assert time.process_time() - began < 5  # about a second on an idle machine
    assert edit_distance(a, "") == 100_000 and edit_distance(a, a[5:]) == 5


def test_rates_and_summary(spark):
    rows = [(1, "The  CAT", "the cat"), (2, "Café", "café"), (3, "a b c d", "a x c"), (4, "", ""), (5, None, "two words"), (6, "abc", None), (7, "kitten", "sitting")]
    df = spark.createDataFrame(rows, "id int, expected string, found string").repartition(3)
    rates = metrics.error_rates(df)
    got = {r.id: (r.char_errors, r.chars, r.cer, r.word_errors, r.words, r.wer) for r in rates.collect()}
    assert got == {1: (0, 7, 0, 0, 2, 0), 2: (0, 4, 0, 0, 1, 0), 3: (3, 7, 0.428571, 2, 4, 0.5), 4: (0, 0, 0, 0, 0, 0), 5: (9, 0, 1, 2, 0, 1), 6: (3, 3, 1, 1, 1, 1), 7: (3, 6, 0.5, 1, 1, 1)}
    s = metrics.error_summary(rates).first()
    assert (s.samples, s.cer, s.wer, s.char_accuracy, s.word_accuracy) == (7, round(18 / 27, 4), round(6 / 9, 4), round(1 - 18 / 27, 4), round(1 - 6 / 9, 4))
    assert (s.cer_min, s.cer_max, s.cer_median, s.wer_mean) == (0, 1, 0.4286, 0.5)
    assert metrics.error_summary(rates.limit(0)).first().cer == 0


def test_entity_summary(spark):
    make = lambda rows: spark.createDataFrame(rows, "item_id int, entity_type string, value string")
    s = metrics.entity_prf_summary(metrics.entity_prf(make([(1, "a", "x"), (1, "a", "y"), (1, "b", "z")]), make([(1, "a", "x"), (1, "c", "w")]))).first()
    assert (s.types, s.tp, s.fp, s.fn, s.precision, s.recall, s.micro_f1) == (3, 1, 1, 2, 0.5, 0.333333, 0.4) and s.macro_f1 == round(2 / 3 / 3, 6)
    assert metrics.entity_prf_summary(metrics.entity_prf(make([]), make([]))).first().macro_f1 == 0
