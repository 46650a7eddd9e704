"""Pictures, formulas and objects do not take the text around them with them."""

import pytest

from evidark.llm.blocks import leaf_blocks


@pytest.mark.parametrize("page, want", [
    ("<p>one</p><svg width='1'/><p>two</p><svg><text>drawn</text></svg><p>three</p>", ["one", "two", "three"]),
    ("<p>one</p><math/><p>two <math><mi>x</mi></math></p><p>three</p>", ["one", "two x", "three"]),
    ("<p>one</p><svg><p>two</p>", ["one", "two"]),
    ("<p>one</p><math><p>two</p>", ["one", "two"]),
    ("<p>one</p><object data='a'><p>two</p>", ["one", "two"]),
    ("<p>one</p><object data='a'><p>instead</p></object><p>two</p>", ["one", "instead", "two"]),
])
def test_text_is_kept(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


def test_many_unclosed_elements_take_time_in_proportion():
    import time

    seconds = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert len(leaf_blocks("<svg><p>a" * n)) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 9 * seconds[0] + 0.2  # a search to the page's end for each would be 16 times as long
