import re

import pytest

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, copies, shared passages, clashing column names."""
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [
        (1, f"alpha beta {passage} gamma"), (2, f"delta {passage} epsilon zeta"), (3, None), (4, ""), (5, " \n\t "), (6, passage), (7, passage), (7, passage),
        (8, "Short One."), (9, "short one."), (10, "é日本 " * 3000), (11, "é日本 " * 2990), (12, "a\nb\nb\nb"), (None, passage), (13, "x" * 500), (14, "x" * 400 + "y" * 100), (15, passage + " " + passage), (7, "another text with the id of seven"),
    ]
    return spark.createDataFrame([(d, t, "en", 1, "k") for d, t in rows], "doc_id long, text string, lang string, row long, names string")
