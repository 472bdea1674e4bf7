"""Vector codes, resampling and mixing against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from proseloom.llm import mixing, radix, resampling, vector_codes
from proseloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# Ranks


def in_order(rows, keys):
    def key(row):
        parts = []
        for name, falling in keys:
            value = row[name]
            parts.append((value is None, 0 if value is None else -value if falling else value))
        return parts

    return sorted(rows, key=key)


@pytest.mark.parametrize("bits", [(10, 13), (2, 3)])
def test_ranks_follow_all_keys(ready, monkeypatch, bits):
    monkeypatch.setattr(radix, "DIGIT_BITS", bits[0])
    monkeypatch.setattr(radix, "BLOCK_BITS", bits[1])
    draw = random.Random(3)
    rows = [(draw.choice([None, -5, 0, 7, draw.randint(-90, 90)]), draw.choice([None, draw.randint(0, 40)]), "x") for _ in range(90)]
    rows += [(7, 7, "tie")] * 20
    frame = ready.createDataFrame(rows, "a long, b long, c string").repartition(3)
    keys = [("a", True), ("b", False)]
    found = sorted(radix.ranked(frame, keys).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == list(range(1, len(rows) + 1))
    wanted = in_order([{"a": a, "b": b} for a, b, _ in rows], keys)
    assert [(r["a"], r["b"]) for r in found] == [(r["a"], r["b"]) for r in wanted]
    assert Counter(r["c"] for r in found)["tie"] == 20


def test_ranks_of_extreme_keys(ready):
    values = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 42]
    frame = ready.createDataFrame([(v,) for v in values], "a long")
    for falling in (False, True):
        found = sorted(radix.ranked(frame, [("a", falling)]).collect(), key=lambda r: r["rank"])
        assert [r["a"] for r in found] == sorted(values, reverse=falling)
    assert radix.ranked(frame.where("false"), [("a", True)]).count() == 0


# Resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(documents, target, buckets, longest, fewest, share, seed=2024):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in documents:
        s.update(map(bucket, features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, features(text, longest)[1]))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for doc_id, text in documents:
        words, found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        name = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, len(words) >= fewest])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * share // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("longest, piece", [(1, 1 << 20), (3, 40)])
def test_resampling_equals_plain_sums(ready, monkeypatch, longest, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    draw = random.Random(longest)
    words = ["Alpha", "beta", "gamma9", "çédille", "漢字", "x_y", "don't", "0", "Z" * 100]
    documents = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))) for k in range(60)]
    documents += [(None, "beta " * 30), (61, None), (62, ""), (5, documents[5][1]), (63, " beta—gamma")]
    target = [" ".join(draw.choice(words[:3]) for _ in range(30)) for _ in range(5)] + [None, ""]
    frame = ready.createDataFrame([(d, t, 1, 2.0) for d, t in documents], "doc_id long, text string, rank int, score double").repartition(3)
    other = ready.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(frame, other, buckets=50, longest=longest, fewest_words=8, share=40)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # Of two equal rows either may hold the earlier rank.
    assert sorted(map(tuple, found.collect()), key=repr) == resampled(documents, target, 50, longest, 8, 40)


def test_resampling_of_odd_and_empty_tables(odd, nothing):
    rows = resampling.resample(odd, odd).collect()
    assert len(rows) == odd.count()
    able = sum(1 for r in odd.collect() if len(features(r["text"], 1)[0]) >= resampling.FEWEST_WORDS)
    assert sum(r["rank"] is not None for r in rows) == able * resampling.SHARE // 100
    assert resampling.resample(nothing, odd).count() == 0
    assert resampling.resample(odd, nothing).count() == odd.count()


# Mixing


def targets(sizes, weights=(1, 2, 3), most=3, share=100):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    left, free, found = sum(sizes.values()) * share / 100, set(names), {}
    while free:
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if level * weight[n] > most * sizes[n]}
        if not full:
            return found | {n: level * weight[n] for n in free}
        for n in full:
            found[n] = float(most * sizes[n])
            left -= found[n]
        free -= full
    return found


def mixed(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    return by_source


def test_mix_meets_targets_with_tilted_rates(ready):
    draw = random.Random(11)
    names = ["b", "a", None, "é", "Z", "tiny", "empty"]
    rows = []
    for k in range(1500):
        name = draw.choice(names[:4] + ["a"] * 6 + ["Z"])
        rows.append((k, name, " ".join(["w"] * max(1, int(draw.lognormvariate(3, 1))))))
    rows += [(2000, "tiny", "only three words"), (2001, "empty", " \t\n"), (2002, "empty", None), (2003, "a", "")]
    frame = ready.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    found = mixing.mix(frame).collect()
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((d, len((t or "").split())) for d, _, t in rows)
    by_source = mixed(found)
    sizes = {n: sum(r["size"] for r in rs) for n, rs in by_source.items()}
    wanted = targets(sizes)
    for name, docs in by_source.items():
        assert {r["source_size"] for r in docs} == {sizes[name]}
        assert all(r["target"] == pytest.approx(wanted[name], rel=1e-9) for r in docs)
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in docs)
        filled = [r for r in docs if r["size"]]
        if not filled:
            continue
        # Rates give the target exactly, and their logs rise in proportion to the size.
        assert sum(r["rate"] * r["size"] for r in filled) == pytest.approx(wanted[name], rel=1e-6)
        tilts = [math.log(r["rate"]) / r["size"] for r in filled if r["rate"] < 3]
        assert not tilts or max(tilts) - min(tilts) < 1e-9
        assert abs(sum(r["taken"] for r in docs) - wanted[name]) <= max(1, min(r["size"] for r in filled))
    again = mixing.mix(frame.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mix_of_odd_and_empty_tables(odd, nothing):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    texts = Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"]) for r in found) == texts
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(odd.where("text IS NULL OR text = ''")).agg({"taken": "sum"}).first()[0] == 0


def test_mix_of_given_documents(ready):
    found = QUERIES["op13_mixing"](ready, SF).collect()
    assert len(found) == 200 and all(r["taken"] <= 3 * r["size"] for r in found)


# Vector codes


def quantised(rows, parts, entries, rounds):
    kept = [(v, l, [math.floor(256 * x) for x in e]) for v, l, e in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(order[0][2]) // parts
    cut = lambda e, p: e[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in order[:entries]] for p in range(parts)]

    def nearest(part, p):
        return min(((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p])))

    for _ in range(rounds):
        for p in range(parts):
            found = defaultdict(list)
            for r in kept:
                found[nearest(cut(r[2], p), p)[1]].append(cut(r[2], p))
            books[p] = [[sum(c) // len(c) for c in zip(*found[k])] if k in found else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for v, label, e in kept:
        near = [nearest(cut(e, p), p) for p in range(parts)]
        out.append((v, label, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    sums = Counter()
    for r in out:
        sums[r[1]] += r[3]
    return sorted(((*r, sums[r[1]], digest) for r in out), key=repr)


def vectors(seed, count, length, spread):
    draw = random.Random(seed)
    rows = []
    for k in range(count):
        base = draw.choice([0.0, 1.5, -2.0])
        vector = [round(base + draw.gauss(0, spread), 2) for _ in range(length)]
        rows.append((k * 3 - 50, draw.choice([None, 1, 2]), vector))
    rows += [(k + 1000, 1, rows[7][2]) for k in range(count // 3)]
    rows += [(None, None, rows[3][2]), (rows[4][0], 2, rows[9][2])]
    return rows


@pytest.mark.parametrize("leaf, block", [(4, 64), (96, 2048)])
def test_codes_equal_full_comparison(ready, monkeypatch, leaf, block):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = vectors(5, 240, 12, 0.4)
    bad = [(5000, 1, None), (5001, 2, [None] * 12), (5002, 1, [float("nan")] * 12), (-99, 2, [1.0] * 11 + [float("inf")]), (-98, 1, [1.0] * 11 + [float("-inf")])]
    schema = "vec_id long, label int, embedding array<double>, code int, error string"
    frame = ready.createDataFrame([(*r, 1, "x") for r in rows + bad], schema).repartition(3)
    found = vector_codes.compress(frame, parts=4, entries=10, rounds=2)
    assert sorted(map(tuple, found.collect()), key=repr) == quantised(rows, 4, 10, 2)


def test_balls_cache_sums_and_spare_comparisons():
    draw = np.random.default_rng(1)
    centres = draw.integers(-4000, 4000, (12, 4))
    points = np.concatenate([c + draw.integers(-60, 60, (300, 4)) for c in centres])
    tree = vector_codes.PartTree(points)
    assert tree.count[-1] == len(points) and (tree.sums[-1] == points.sum(0)).all()
    entries, compared = np.concatenate([centres, centres[:3], centres + 3000]), []
    codes, sums, counts = tree.assign(entries, compared)
    wanted = ((points[:, None] - entries) ** 2).sum(2).argmin(1)
    assert (codes[tree.place] == wanted).all()
    assert (counts == np.bincount(wanted, minlength=len(entries))).all()
    assert all((sums[k] == points[wanted == k].sum(0)).all() for k in range(len(entries)))
    assert sum(compared) < len(points) * len(entries) / 20


def test_codes_of_large_numbers_ties_and_odd_tables(ready):
    rows = [(k, 0, [float(200_000 - k % 5), -200_000.0 + k % 3]) for k in range(60)]
    frame = ready.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = vector_codes.compress(frame, parts=2, entries=7, rounds=2)
    assert sorted(map(tuple, found.collect()), key=repr) == quantised(rows, 2, 7, 2)
    assert vector_codes.compress(frame.where("false"), parts=2).count() == 0
    assert vector_codes.compress(frame.drop("label"), parts=2, entries=3).where("label IS NULL").count() == 60
    mixed_lengths = frame.union(ready.createDataFrame([(3, 1, [1.0]), (100, 1, [])], frame.schema))
    assert vector_codes.compress(mixed_lengths, parts=2, entries=5).count() == 60
    with pytest.raises(ValueError):
        vector_codes.compress(frame, parts=3)


def test_codes_of_given_vectors(ready):
    vectors = ready.read.parquet(f"{SF}/embeddings.parquet")
    found = vector_codes.compress(vectors)
    rows = vectors.collect()
    wanted = quantised([(r["vec_id"], r["label"], r["embedding"]) for r in rows], 16, 64, 2)
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
