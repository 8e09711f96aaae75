"""The vectorised gram cutter against cutting each word by hand."""

from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.operators.ngrams import GramIndex, _row_terms

WORDS = st.text(st.sampled_from("abé日𝒳'"), max_size=9)


def by_hand(words, terms):
    number, seen = {t: i for i, t in enumerate(terms)}, Counter()
    for w in words:
        w = f" {w} "
        for k in (3, 4, 5):
            seen.update(number[w[i:i + k]] for i in range(len(w) - k + 1) if w[i:i + k] in number)
    return sorted(seen.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=12), max_size=9), st.sets(st.text(st.sampled_from("abé日𝒳' "), min_size=3, max_size=5), max_size=40),
       st.integers(1, 200))
def test_rows_of_words(rows, terms, cells):
    terms = sorted(terms)
    index = GramIndex(terms)
    known = pa.array([w for r in rows for w in r], pa.string()).dictionary_encode()
    offsets = np.cumsum([0, *map(len, rows)])
    got = []
    for ends, ids, counts in _row_terms(index, offsets, known.indices.to_numpy(), index.of_words(known.dictionary), cells):
        cuts = np.cumsum([0, *ends])
        got += [list(zip(ids[a:b].tolist(), counts[a:b].astype(int).tolist())) for a, b in zip(cuts[:-1], cuts[1:])]
    assert got == [by_hand(r, terms) for r in rows]
