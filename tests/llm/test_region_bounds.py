import pytest

from sylvan.llm.ngram_jaccard import _near, _prefix, _region_sizes


@pytest.mark.parametrize("threshold", [80, 90])
def test_regions_cover_every_partner(threshold):
    """An element among a partner's near least ones, if shared, lies in the region."""
    for n in range(1, 1200):
        region = min(n, _region_sizes(n, threshold)[1])
        for m in range(max(1, -(-n * threshold // 100)), n * 100 // threshold + 1):
            assert region >= min(n, _near(m, threshold) + _prefix(n, threshold) - 1)
