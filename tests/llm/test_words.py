import numpy as np

from triplewright.llm.words import shingle_set, window_hashes, word_codes


def test_window_hashes_are_equal_where_windows_are():
    words = [b"a", b"b", b"a", b"b", b"a", b"b", b"c", b"a", b"b", b"a"]
    for width in (1, 2, 3, 5, 7, 10):
        hashes = window_hashes(word_codes(words), width).tolist()
        windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
        assert len(hashes) == len(windows)
        for i, a in enumerate(windows):
            for j, b in enumerate(windows):
                assert (hashes[i] == hashes[j]) == (a == b)


def test_short_texts():
    assert len(window_hashes(word_codes([b"a"]), 2)) == 0
    assert len(shingle_set([], 5)) == 0
    assert len(shingle_set([b"a", b"b"], 5)) == 1
    assert (np.diff(shingle_set([b"a"] * 9 + [b"b"], 5).astype(object)) > 0).all()
