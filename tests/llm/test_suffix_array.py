import numpy as np
import pytest
from annolake.llm.suffix_array import common_prefixes, suffix_array


@pytest.mark.parametrize("alphabet", [1, 2, 3, 26, 256])
def test_order_and_prefixes_match_plain_sorting(alphabet):
    r = np.random.default_rng(alphabet)
    for n in [0, 1, 2, 3, 7, 50, 400]:
        for _ in range(8):
            data = r.integers(0, alphabet, n).astype(np.uint8)
            text, depth = data.tobytes(), 24
            order = suffix_array(data, depth)
            assert sorted(order.tolist()) == list(range(n))
            keys = [text[i : i + depth] for i in order]
            assert keys == sorted(keys)
            shared = common_prefixes(data, order, depth)
            for k in range(1, n):
                a, b = text[order[k - 1] :][:depth], text[order[k] :][:depth]
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert shared[k] == same


def test_long_runs_and_zero_bytes():
    data = np.frombuffer(b"a" * 3000 + b"\0" * 3000 + b"ab" * 1500, np.uint8)
    order, text = suffix_array(data, 104), data.tobytes()
    keys = [text[i : i + 104] for i in order]
    assert keys == sorted(keys)


def test_a_part_of_the_suffixes():
    r = np.random.default_rng(0)
    for alphabet in (1, 2, 4, 256):
        for n in (1, 2, 30, 300):
            data = r.integers(0, alphabet, n).astype(np.uint8)
            for share in (0.0, 0.2, 0.8):
                wanted = r.random(n) < share
                text, order = data.tobytes(), suffix_array(data, 16, wanted)
                assert sorted(order.tolist()) == np.nonzero(wanted)[0].tolist()
                keys = [text[i : i + 16] for i in order]
                assert keys == sorted(keys)
