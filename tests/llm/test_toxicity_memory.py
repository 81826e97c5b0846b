"""Equal words of the texts that are fitted on are held once."""

from kembar.llm import toxicity


def test_equal_words_are_one_object():
    texts = ["Kata kata, lain", None, "", "lain KATA", "x" * 200]
    words = toxicity.shared_words(texts)
    assert words == [toxicity.bare_words(text) for text in texts]
    flat = [w for text in words for w in text]
    assert len({id(w) for w in flat}) == len(set(flat)) < len(flat)
