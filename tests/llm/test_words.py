"""Ids of words."""

from pathloom.llm import packing


def test_words_are_merged_when_first_asked_for():
    asked = []
    words = packing.Words(lambda piece: asked.append(piece) or [len(piece)])
    for _ in range(2):
        assert [len(words[w]) for w in ("abc", "ABC,", "d,", "it's")] == [4, 8, 8, 0]
    assert asked.count(b"," + packing.END) == 1 and len(asked) == 4 and words.odd == ["it's", "it's"]


def test_ids_of_odd_texts():
    coder = packing.Ids(packing.tokenizer_path())
    texts = ["a\0b it's don't \u03b1\u03a3 stra\u00dfe", "it's", "", "x\x1dy it's", "<|z", "plain words, PLAIN words,", "\u0130x \u4f60\u597d it's"]
    for _ in range(2):
        assert coder.many(texts) == [coder.whole(t) for t in texts]
    assert not coder.known.odd
