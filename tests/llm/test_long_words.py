from kinmatch.llm.op03_token_counts import MAX_WORD, LongestMatch


def test_long_words_are_counted():
    begin, inner = {"ab", "a"}, {"ab", "c"}
    made = LongestMatch(begin, inner)
    assert made.pieces("ab" * 5000) == 5000 and made.pieces("a" + "c" * MAX_WORD) == MAX_WORD + 1
    assert made.pieces("ab" * 100 + "x") == 1
    assert LongestMatch(begin, inner, longest=MAX_WORD).pieces("ab" * 100) == 1
