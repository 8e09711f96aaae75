import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

ROWS = [
    (1, "Hello wörld, don't panic! Hello again.", "x"), (2, None, None), (3, "", "y"), (4, " \t\n", None),
    (5, "Hello wörld,don't panic! Helloagain.", "x"), (6, "write to a@b.com or b@c.org_d@e.net, +1 (706) 555-3138 now", "x"),
    (7, "card 4111 1111 1111 1111, ip 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5", "x"),
    (8, "long " * 20_000 + "end", "x"), (9, "one two three four five six", "z"), (9, "one two three four five six", "z"),
    (10, "▁ strange  blanks   日本 \x00 <|endoftext|> naïve", "z"), (11, "Released under the MIT License. x", "z"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, s, len(t or ""), 7, 8) for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, key int, f int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
