"""Lower-casing of A-Z alone."""

import string

from pathloom.llm import divergence


def test_only_ascii_letters_are_lowered(spark):
    texts = ["", "ABC xyz [\\]^_`{|}~@", "ÀB éE", "KK İI ΣΣ ẞS", "漢字ABC", "\x00A\x7fZ", "😀QZ", None]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", divergence.lowered(divergence.F.col("text")).alias("t")).collect()
    table = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    assert {r.i: r.t for r in found} == {i: t and t.translate(table) for i, t in enumerate(texts)}
