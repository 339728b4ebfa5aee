"""Token lists out of the tokens of words."""

from array import array

from partlens.llm import piece_codec


def test_lists_of_tokens_are_made_from_their_bytes():
    words = [array("i", [5, 70_000]), array("i", [1])]
    made = piece_codec._lists([b"".join(words), None, b"", words[1].tobytes()])
    assert made.to_pylist() == [[5, 70_000, 1], None, [], [1]]
    assert piece_codec._lists([]).to_pylist() == []
