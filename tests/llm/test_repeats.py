import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from proseloom.llm import repeats


def brute(texts, length=repeats.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefé") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(45), prose(200)
    texts = [prose(draw.randint(0, 120)) for _ in range(20)]
    texts += [prose(30) + shared + prose(draw.randint(0, 30)) for _ in range(12)]
    texts += [long, long, long[:500] + "Q" + long[501:], prose(5) + long[100:] + prose(5)]
    texts += [(prose(3) + ". ") * 60, "ab" * 400, "a" * 1000, "z" * 199, "y" * 200, "y" * 200, None, "", shared[:150] * 3]
    texts += ["k" * 100 + shared[:200], shared[:200] + "m", "é" * 150, "x" + "é" * 150]
    return texts


@pytest.mark.parametrize("most", [repeats.MOST_OF_ONE, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(ready, seed, most):
    """Also where anchors count as too frequent for one task."""
    texts = made(seed)
    table = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r[1:5] for r in repeats.remove_repeats(table, most).collect()}
    assert [tuple(rows[i]) for i in range(len(texts))] == brute(texts)


def test_small_portions_change_nothing(ready, monkeypatch):
    texts = made(3)
    raw = [(t or "").encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = repeats.anchors_of(data, offsets)
    monkeypatch.setattr(repeats, "PLACE_BITS", 30)
    parts = repeats._anchors_in_parts(data, offsets)
    assert sorted(zip(*map(np.ndarray.tolist, whole))) == sorted(zip(*map(np.ndarray.tolist, parts)))


def test_columns_against_pairs():
    draw = np.random.default_rng(5)
    for _ in range(40):
        count, width, length = int(draw.integers(1, 12)), 40, int(draw.integers(3, 12))
        strings = draw.integers(97, 97 + draw.integers(1, 4), (count, width)).astype(np.uint8)
        low, high, group = draw.integers(0, 15, count), draw.integers(25, width + 1, count), draw.integers(0, 3, count)
        found = repeats.repeated(strings, low, high, group, length)
        for i in range(count):
            for c in range(width - length + 1):
                inside = lambda k: low[k] <= c and c + length <= high[k]
                want = inside(i) and any(
                    j != i and group[j] == group[i] and inside(j) and (strings[j, c : c + length] == strings[i, c : c + length]).all()
                    for j in range(count)
                )
                assert found[i, c] == want


def test_odd_rows(odd, nothing):
    rows = odd.collect()
    want = sorted((r.doc_id or -1, *b) for r, b in zip(rows, brute([r.text for r in rows])))
    assert sorted((r.doc_id or -1, *r[1:5]) for r in repeats.remove_repeats(odd).collect()) == want
    assert repeats.remove_repeats(nothing).collect() == []
