import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept boolean, _fp string, block int"


def prose(rnd, n, vocabulary=80):
    return " ".join(rnd.choice(["w", "Wort", "été", "x-y", "don't"]) + str(rnd.randint(0, vocabulary)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and very long texts, copies, near copies, shared passages and repeated rows."""
    rnd = random.Random(11)
    passage = prose(rnd, 60)
    lines = "\n".join(prose(rnd, 6) for _ in range(12))
    out = []
    for i in range(120):
        text = prose(rnd, rnd.randint(0, 150))
        if i % 10 == 1:
            text = passage + " " + text
        if i % 10 == 2:
            text = lines + "\n" + text
        if i % 10 == 3:
            text = out[0][1] + (" extra" if i % 20 == 3 else "")
        if i % 10 == 4:
            text = "\n".join([prose(rnd, 5)] * 9) + " ### $$$ &&& " + text
        if i % 10 == 5:
            text = "Released under the MIT License.\n" + text + "\nlicensed under the Apache License, Version 2.0"
        out.append((i * 3, text, ["en", "fr", None][i % 3], None if i % 17 == 0 else f"src{min(i % 7, 3)}", len(text), "s", True, "f", 1))
    out.append((1000, None, None, None, None, None, None, None, None))
    out.append((1001, "", "en", "src0", 0, None, None, None, None))
    out.append((1002, " \t\n\x0b\x0c\r ", "en", "src0", 0, None, None, None, None))
    out.append((1003, "one", "en", "src1", 3, None, None, None, None))
    out.append((1004, prose(rnd, 30_000, 20_000), "en", "src1", 3, None, None, None, None))
    out.append((1005, "x " * 5_000, "en", "src1", 3, None, None, None, None))
    out.append((None, passage, "en", "src2", 3, None, None, None, None))
    out.append(out[5])  # a repeated row
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return (text or "").encode().split()
