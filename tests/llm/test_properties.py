from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import group_split, lookalike, overlap, packing, scans, truncation


@given(st.text(max_size=30))
@settings(deadline=None)
def test_forms_are_stable(token):
    once = lookalike.by_table(token)
    assert lookalike.by_table(once) == once


@given(st.dictionaries(st.integers(1, 9), st.integers(1, 4), min_size=1, max_size=4))
@settings(deadline=None, max_examples=60)
def test_first_choice_is_the_closest_total(sizes):
    shares = {"DEV": 0.6, "REGRESSION": 0.25, "FINAL_HOLDOUT": 0.15}
    plan = group_split.choose(dict(sizes), shares)["REGRESSION"]
    target = round(sum(s * k for s, k in sizes.items()) * 0.25)
    got = sum(s * k for s, k in plan.items())
    totals = {sum(s * n for s, n in zip(sizes, pick)) for pick in product(*[range(k + 1) for k in sizes.values()])}
    assert all(plan.get(s, 0) <= k for s, k in sizes.items())
    assert abs(got - target) == min(abs(t - target) for t in totals)


@given(st.lists(st.integers(1, 255), min_size=1, max_size=60), st.floats(0.3, 0.95))
@settings(deadline=None)
def test_listed_prefix_leaves_less_than_the_bound(weights, bound):
    w = np.sort(np.array(weights, dtype=float))[::-1]
    w /= np.linalg.norm(w)
    k = overlap.prefix_length(w, bound)
    assert np.linalg.norm(w[k:]) < bound + 1e-9 and (k == 1 or np.linalg.norm(w[k - 1 :]) >= bound - 1e-9)


@given(st.lists(st.integers(0, 300), max_size=80), st.integers(1, 128))
@settings(deadline=None)
def test_packer_loses_nothing(sizes, capacity):
    p = packing.Packer("k", capacity, "k")
    rows = p.window(range(len(sizes)), sizes)
    held, boxes = {}, {}
    for doc, _, _, n, box in rows:
        held[doc] = held.get(doc, 0) + n
        boxes[box] = boxes.get(box, 0) + n
    assert held == dict(enumerate(sizes)) and all(v <= capacity for v in boxes.values())


@given(st.text(max_size=200))
@settings(deadline=None)
def test_text_functions_take_anything(text):
    scans.noise_of(text, scans.running_headings(text) if text.strip() else [])
    scans.repaired_text(text, [], {})
    truncation.ending(text)
    overlap.terms_of(text)
