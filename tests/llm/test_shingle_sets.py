"""Sets of a block of texts, made at once, against those of each text."""

import numpy as np

from provenia.llm import jaccard


def test_sets_of_a_block_are_those_of_its_texts():
    rng = np.random.default_rng(7)
    for sizes in ([], [0], [0, 0], [3], [4, 5], [5], [0, 40, 2, 0, 9, 4, 300, 0], [5] * 50):
        words = rng.integers(0, 6, sum(sizes)).astype(np.uint64)
        want = [jaccard.shingles(w) for w in np.split(words, np.cumsum(sizes)[:-1])] if sizes else []
        flat, held = jaccard.shingle_sets(words, sizes)
        assert held.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w.tolist()]
        keys = flat & jaccard.COUNTED
        assert jaccard.key_places(flat).tolist() == np.searchsorted(np.unique(keys), keys).tolist()
