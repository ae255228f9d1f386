from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, row int, words string, sha string, node long, h long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, and columns with the names of inner ones."""
    draw = random.Random(5)
    pool = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(draw.choices(pool, k=n))
    long, passage, shared = prose(40_000), prose(30), prose(60)
    edited = [shared.replace(shared.split()[i], "edit", 1) for i in (7, 30)]
    rows = [
        (1, shared), (2, shared), (9, shared.upper()), (4, edited[0]), (5, edited[1]), (None, shared), (None, None), (6, None), (7, ""), (7, ""),
        (8, "   \t\n"), (10, long), (11, long[:150_000] + " x"), (12, prose(20) + " " + passage), (13, passage + "\n" + prose(20)), (13, passage),
        (14, "short"), (15, "short"), (16, "ß𝄞 😀 naïve　text"), (17, "aaaa" * 100), (18, "a" * 250), (19, "x" * 99), (20, "x" * 99), (21, "y" * 100), (22, "y" * 101),
        (23, "mail: a.b@c-d.example.org_e@f.gh, ip 1.2.3.4.5 and 256.1.1.1, card 4111 1111 1111 1111, tel +49 (30) 1234567-8"),
        (24, "IBAN DE89 3704 0044 0532 0130 00 or DE88370400440532013000"), (25, "9" * 20_000), (26, "a@" + "b." * 20_000), (27, "<|endoftext|> <s> ▁ end  "),
    ]
    data = [(d, t, None, i % 3, "w", None, i, None) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def plain():
    return pairs
