import random
import re

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, digest int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def prose(draw, n):
    return " ".join("".join(draw.choice(["th", "er", "an", "in", "ou", "st", "é"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, exact and near copies, ties, repeated rows."""
    draw = random.Random(5)
    base = [prose(draw, 120) for _ in range(6)]
    rows = [(k, base[k]) for k in range(6)]
    for k in range(6, 14):  # near copies
        w = base[k % 3].split()
        w[draw.randrange(len(w))] = "zz"
        rows.append((k, " ".join(w)))
    passage = prose(draw, 60)
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, "one two"), (24, "one two"), (25, base[0]), (26, base[0]), (26, base[0]), (27, "日本 ▁x  y"), (28, "word " * 6000), (29, prose(draw, 9000)), (None, base[4]), (None, None), (30, base[5] + "\n" + passage), (31, passage + "\nand more"), (32, "x\n" + passage + "\n" + passage), (33, 'key token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" end')]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns, some named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", None, len(t) if t else None, 0.5, "n", 7) for i, t in odd_rows()], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
