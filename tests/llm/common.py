"""Small tables for the tests of the training-data operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs_frame(spark, rows, extra=False):
    """doc_id, text; with ``extra`` also columns whose names operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ["id", "key", "fingerprint", "score", "row", "label", "repeats", "ids", "ratio", "n_words", "_batch"]
    return spark.createDataFrame([(*r, *[f"x{i}" for i in range(len(names))]) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))


ODD = [None, "", " ", "\n\t ", "a", "one two", "é ñ ß", "x y z", "tab\tand\x0bmore\r\nlines", "\U0001F600 ok"]


def prose(seed, n, size=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))
