import numpy as np
import pyarrow as pa

from graingrid.llm.textcore import Words, flat, powers, word_hash


def test_hashes_tell_anagrams_apart_and_do_not_depend_on_what_came_before():
    assert word_hash("stone") != word_hash("notes") != word_hash("onset")
    before = word_hash("stone")
    assert powers(3)[1] != 1
    Words(*flat(pa.array(["x" * 5000])))
    assert word_hash("stone") == before == int(Words(*flat(pa.array(["a Stone"]))).hash[1])


def test_nulls_and_empty_texts_have_no_words():
    w = Words(*flat(pa.array([None, "", "!?", "a"])))
    assert np.diff(w.ptr).tolist() == [0, 0, 0, 1]
    assert len(Words(*flat(pa.array([], pa.string()))).hash) == 0
