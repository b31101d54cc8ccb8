"""The word of which a record consists."""

from codesim.llm import residue


def test_the_majority_word_is_that_of_the_whole_record():
    opening = [f"w{i % 25}" for i in range(50)]
    assert residue._monotone(opening + ["blah"] * 400) == "blah"
    assert residue._monotone(["blah"] * 40 + ["other"] * 39) is None
