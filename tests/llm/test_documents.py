"""Line spread, contamination, near duplicates, link trust and the pipeline."""

import importlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from proseloom.llm import contamination, lines, links, near_duplicates
from proseloom.llm.components import components
from proseloom.llm.queries import ORACLES

WORDS = [a + b for a in "ba ke li mo nu ra sy te vo zi".split() for b in "lan mer tok dis pra fen gul hor jat wex".split()]


def prose(draw, count):
    return " ".join(draw.choice(WORDS) for _ in range(count))


def shingles(text, size=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def edit(draw, text, count):
    words = text.split()
    for _ in range(count):
        words[draw.randrange(len(words))] = "new" + draw.choice(WORDS)
    return " ".join(words)


def grouped(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Near duplicates


def families(seed):
    draw = random.Random(seed)
    texts = [prose(draw, draw.randint(3, 120)) for _ in range(60)]
    for _ in range(8):
        base = prose(draw, 150)
        texts += [edit(draw, base, draw.randint(0, 6)) for _ in range(draw.randint(2, 12))]
    # Chains: neighbours are alike, the ends are not.
    chain = prose(draw, 200)
    for _ in range(8):
        texts.append(chain)
        chain = edit(draw, chain, 3)
    texts += [texts[0], texts[0], "one two", "One, two!", "...", "...", "?", None, "", ""]
    # Repeats weigh: the same distinct shingles, not the same counts.
    loop = "a b c d e f g h "
    return [*texts, loop * 10, loop * 11, loop * 30]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_equal_brute_force(ready, seed):
    texts = families(seed)
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if similarity(sets[a], sets[b]) >= 0.8]
    pairs += [(a, b) for b in range(len(texts)) for a in range(b) if texts[a] and texts[a] == texts[b]]
    want = grouped(range(len(texts)), pairs)
    table = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = near_duplicates.near_duplicates(table).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    assert {r.doc_id for r in rows if r.kept} == set(want.values())


def test_buckets_in_several_parts_are_compared(ready, monkeypatch):
    """With one representative a bucket, which need not be similar to all others in it."""
    monkeypatch.setattr(near_duplicates, "PIVOTS", 1)
    texts = families(4)
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if similarity(sets[a], sets[b]) >= 0.8]
    pairs += [(a, b) for b in range(len(texts)) for a in range(b) if texts[a] and texts[a] == texts[b]]
    table = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(table).collect()} == grouped(range(len(texts)), pairs)


def test_signatures_agree_as_often_as_texts_are_alike():
    draw = random.Random(9)
    base = prose(draw, 300)
    for count in (0, 2, 6, 20):
        other = edit(draw, base, count)
        regions, numbers = near_duplicates.regions_of(pa.array([base, other]))
        marks = near_duplicates.signatures_of(regions, numbers, 2000)
        assert abs((marks[0] == marks[1]).mean() - similarity(shingles(base), shingles(other))) < 0.05
        one, two = set(regions[: numbers[0]].tolist()), set(regions[numbers[0] :].tolist())
        assert abs(len(one & two) / len(one | two) - similarity(shingles(base), shingles(other))) < 1e-9


def test_signature_of_a_text_does_not_depend_on_its_batch():
    draw = random.Random(3)
    texts = [prose(draw, n) for n in (1, 4, 5, 6, 40, 900)]
    together = near_duplicates.signatures_of(*near_duplicates.regions_of(pa.array(texts)))
    for text, marks in zip(texts, together):
        assert (near_duplicates.signatures_of(*near_duplicates.regions_of(pa.array([text])))[0] == marks).all()


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    classes = defaultdict(set)
    for r in rows:
        classes[r.doc_id].add(r.class_id)
    assert classes[1] == classes[2] == {1} and classes[3] == {3} and classes[4] == {4}
    assert sum(r.kept for r in rows if r.doc_id in (1, 2)) == 1
    assert all(r.kept for r in rows if r.doc_id is None)
    assert near_duplicates.near_duplicates(nothing).collect() == []


def test_ids_with_several_texts_tie_them(ready):
    draw = random.Random(12)
    a, b, c = prose(draw, 80), prose(draw, 80), prose(draw, 80)
    rows = [(3, a), (4, b), (5, a), (5, b), (6, c), (7, c.replace(" ", "  ")), (8, prose(draw, 80)), (8, None), (9, "")]
    found = near_duplicates.near_duplicates(ready.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in found} == {(3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (8, 8), (9, 9)}
    assert sorted(r.doc_id for r in found if r.kept) == [3, 6, 8, 9]


def test_typographic_signs_part_words(ready):
    draw = random.Random(13)
    words = prose(draw, 60).split()
    plain = " ".join(words)
    signs = " ".join(words[:10]) + "\u2014" + " ".join(words[10:30]) + " \u201c" + " ".join(words[30:40]) + "\u201d\u2026" + " ".join(words[40:])
    rows = [(1, plain), (2, signs), (3, " ".join(f"é{w}" for w in words)), (4, "·".join(f"é{w}" for w in words)), (5, "漢字かな" * 9), (6, "漢字かな" * 9 + "。")]
    found = near_duplicates.near_duplicates(ready.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def test_components_of_long_paths(ready):
    draw = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 300) if i % 50] + [(draw.randint(400, 500), draw.randint(400, 500)) for _ in range(80)]
    draw.shuffle(pairs)
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    want = grouped(nodes, [p for p in pairs if p[0] != p[1]])
    found = components(ready.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == want
    assert components(ready.createDataFrame([], "a long, b long")).collect() == []


def test_stars_are_written_once(ready, monkeypatch):
    """Edges that are stars already take no further round, a path of stars only a few."""
    module, written = importlib.import_module("proseloom.llm.components"), []
    store = module.stored
    monkeypatch.setattr(module, "stored", lambda frame: written.append(1) or store(frame))
    star = ready.createDataFrame([(n, 1) for n in range(2, 40)] + [(60, 50)], "a long, b long")
    found = {r["node"]: r["root"] for r in module.components(star).collect()}
    assert found == {n: 1 for n in range(1, 40)} | {60: 50, 50: 50}
    assert len(written) == 1


# Line spread


def test_spread_lines_against_sql(ready, tmp_path):
    draw = random.Random(4)
    common = [prose(draw, 4) for _ in range(12)]
    rows = []
    for i in range(400):
        own = [prose(draw, draw.randint(1, 8)) for _ in range(draw.randint(0, 6))]
        own += [draw.choice(common[: 1 + i % 12]) for _ in range(draw.randint(0, 3))] + draw.choice([[], [""], ["  "]])
        draw.shuffle(own)
        rows.append((i, "\n".join(own) if i % 17 else None, f"s{draw.randint(0, 3 + i % 12)}" if i % 23 else None))
    table = ready.createDataFrame(rows, "doc_id long, text string, source string")
    with duckdb.connect() as engine:
        documents = table.toPandas()
        engine.register("documents", documents)
        want = {r[0]: r[1:] for r in engine.execute(ORACLES["op9_line_spread"]).fetchall()}
    found = lines.remove_boilerplate(table).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == want
    assert sum(r.n_removed for r in found) > 20


def test_lines_of_odd_rows(odd, nothing):
    rows = lines.remove_boilerplate(odd)
    assert set(odd.columns) <= set(rows.columns) and rows.count() == odd.count()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert lines.remove_boilerplate(nothing).collect() == []


def test_copies_stay_whole(ready):
    rows = [(i, "line one here\nline two here\nand a third line", f"s{i}") for i in range(20)]
    rows += [(100 + i, f"footer of the site\nown words of page {i}, and many more than that", f"s{i}") for i in range(20)]
    found = {r.doc_id: r for r in lines.remove_boilerplate(ready.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i].n_removed == 0 for i in range(20))
    assert all(found[100 + i].text == f"own words of page {i}, and many more than that" for i in range(20))


# Contamination


def brute_contamination(texts, items):
    out = {}
    for d, text in texts:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for i, item in items:
            size = len(re.findall(r"[^\W_]+", (item or "").lower()))
            if not size or i is None:
                continue
            k, want = min(size, 5), shingles(item)
            for start in range(len(words)):
                cut = words[start : start + size]
                if len(cut) < k:
                    break
                got = Counter(tuple(cut[j : j + k]) for j in range(len(cut) - k + 1))
                s = similarity(got, want)
                if s >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_passages_against_brute_force(ready):
    draw = random.Random(6)
    items = [(i, prose(draw, draw.randint(5, 60))) for i in range(25)] + [(25, "just two"), (26, "word"), (27, ""), (28, None), (None, prose(draw, 9))]
    items += [(29, "the same words and again the same words and again the same words"), (3, prose(draw, 20))]
    texts = []
    for d in range(120):
        item = draw.choice(items[:25])[1]
        body = {0: item, 1: edit(draw, item, 1), 2: edit(draw, item, 3), 3: item[: len(item) // 2], 4: item.upper().replace(" ", ", ")}
        texts.append((d, f"{prose(draw, draw.randint(0, 40))} {body.get(d % 6, '')} {prose(draw, draw.randint(0, 40))}"))
    texts += [(200, "Just two."), (201, "It is just, TWO of them"), (202, None), (203, ""), (204, items[-2][1]), (204, items[-1][1])]
    table = ready.createDataFrame(texts, "doc_id long, text string")
    found = contamination.contaminated(table, ready.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contamination(texts, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert len(found) == len(got)
    # Windows are laid where a shingle of the item would lie, which may miss a better one beside it.
    assert set(got) <= set(want) and all(got[k] <= want[k] + 1e-9 for k in got)
    assert {k for k, s in want.items() if s > 0.9} <= set(got) and len(got) >= 0.97 * len(want)


def test_reordered_passages_against_brute_force(ready):
    draw = random.Random(16)
    items = [(i, prose(draw, draw.choice([8, 30, 60, 90]))) for i in range(12)] + [(12, prose(draw, 60))]
    texts = []
    for d in range(60):
        words = items[d % 13][1].split()
        at = draw.choice([len(words) // 2, len(words) // 3, 4])
        moved = words[at:] + words[:at]
        texts.append((d, f"{prose(draw, 6 + d % 30)} {edit(draw, ' '.join(moved), d % 2)} {prose(draw, 6 + d % 20)}"))
    # Items that an end of the text cuts, and a text of many hits.
    texts += [(100 + i, f"{prose(draw, 9)} {' '.join(t.split()[:-3])}") for i, t in items]
    texts += [(200, " ".join(items[12][1].split()[30:] + items[12][1].split()[:30])), (201, f"{items[12][1]} " * 5)]
    table = ready.createDataFrame(texts, "doc_id long, text string")
    found = contamination.contaminated(table, ready.createDataFrame(items, "item_id long, text string"), radius=23).collect()
    want = brute_contamination(texts, items)
    assert (200, 12) in want and len(want) > 20
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert set(got) == set(want) and all(abs(got[k] - s) < 1e-9 for k, s in want.items())


def test_contamination_of_odd_rows(ready, odd, nothing):
    items = ready.createDataFrame([(1, "A plain text with some words in it", 1), (2, None, 2), (None, "x", 3)], "item_id long, text string, score int")
    assert sorted((r.doc_id, r.item_id) for r in contamination.contaminated(odd, items).collect()) == [(1, 1), (2, 1)]
    items = ready.createDataFrame([(1, "a plain text, with SOME words in it of no great length", 1)], "item_id long, text string, place int")
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in contamination.contaminated(odd, items).collect()) == [(1, 1, 1.0), (2, 1, 1.0)]
    assert contamination.contaminated(nothing, items).collect() == []
    assert contamination.contaminated(odd, items.where("false")).collect() == []


def shuffled(ready):
    """Bytes that this session has written for shuffles so far."""
    context = ready.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_without_a_passage_are_not_shuffled(ready, tmp_path):
    draw = random.Random(41)
    item = prose(draw, 40)
    rows = [(i, " ".join(f"{draw.getrandbits(32):x}" for _ in range(600)) + (f" {item}" if i % 100 == 7 else "")) for i in range(1500)]
    ready.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ready.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, items = (ready.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "benchmark"))
    before = shuffled(ready)
    found = contamination.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.similarity) for r in found) == [(i, 1.0) for i in range(7, 1500, 100)]
    assert shuffled(ready) - before < 0.2 * sum(len(text) for _, text in rows)


def test_windows_of_long_texts_against_brute_force(ready):
    """Windows whose shingles lie in two stretches, items longer than a stretch, windows that both ends cut."""
    draw = random.Random(42)
    items = [(1, prose(draw, 30)), (2, prose(draw, 300)), (3, prose(draw, 7)), (4, "two words")]
    texts = []
    for d in range(24):
        body = edit(draw, items[d % 4][1], d % 2)
        texts.append((d, f"{prose(draw, 225 + 3 * d)} {body} {prose(draw, draw.choice([0, 3, 400]))} {items[(d + 1) % 4][1]}"))
    for i, t in items[:2]:
        words = t.split()
        few = len(words) // 15
        texts += [(100 + i, " ".join(words[few:])), (200 + i, " ".join(words[:-few])), (300 + i, f"{t} {t} {' '.join(words[:-few])}")]
    table = ready.createDataFrame(texts, "doc_id long, text string")
    found = contamination.contaminated(table, ready.createDataFrame(items, "item_id long, text string"), radius=23).collect()
    want, got = brute_contamination(texts, items), {(r.doc_id, r.item_id): r.similarity for r in found}
    assert set(got) == set(want) and all(abs(got[k] - s) < 1e-9 for k, s in want.items()) and len(want) > 40


def test_filter_keeps_every_key_and_few_others(ready):
    draw = random.Random(43)
    table = ready.createDataFrame([(draw.randint(-(1 << 63), (1 << 63) - 1), str(i)) for i in range(3000)], "hash long, text string")
    edges = ready.createDataFrame([(k, "edge") for k in (0, -1, 1, (1 << 24) - 1, 1 << 24, 7, 8, (1 << 15) - 1, 1 << 15, -(1 << 63))], "hash long, text string")
    both = table.union(edges)
    keys = table.where("text < '2'").union(edges).select("hash")
    rows = [tuple(r) for r in contamination._among(both, keys, "hash").collect()]
    wanted = {tuple(r) for r in both.where("text < '2' OR text = 'edge'").collect()}
    assert len(rows) == len(set(rows)) and wanted <= set(rows) and len(rows) <= len(wanted) + 5
    assert contamination._among(both, keys.where("false"), "hash").collect() == []


def test_fingerprints_by_definition(ready):
    draw = random.Random(8)
    rows = [(k, draw.randint(-(1 << 63), (1 << 63) - 1)) for k in range(20) for _ in range(draw.randint(1, 30))]
    table = ready.createDataFrame(rows, "key long, shingle long")
    for r in contamination.fingerprints(table, "key").collect():
        own = [s & (1 << 64) - 1 for k, s in rows if k == r.key]
        assert r.mark & (1 << 64) - 1 == sum((sum(s >> i & 1 for s in own) * 2 > len(own)) << i for i in range(64))


# Link trust


def web(seed):
    draw = random.Random(seed)
    hosts = ["a.org", "b.org", "Example.org", "x.example.org", "c.com", "d.com", "e.net", "f.net", "g.net", "h.net"]
    rows = []
    for i in range(150):
        to = " ".join(f'<a href="{draw.choice(["http:", "https:", ""])}//{draw.choice(hosts).upper()}/p{i}">x</a>' for _ in range(draw.randint(0, 3)))
        path = draw.choice(["/", "/es/1", "/en/12", "/fr/x", "/de/y", ""])
        rows.append((i, f"http://{draw.choice(hosts)}{path}{draw.choice(['', '?q=://z/', '#f'])}", f"<p>{to}<img src=/local></p>"))
    rows += [(150 + i, f"http://bad.com/de/{i}", "") for i in range(20)]
    rows += [(170 + i, f"http://fan.net/{i}", "<a href='//bad.com/de/1'>") for i in range(20)]
    return rows + [(200, None, None), (201, "no scheme", "<a href='http://a.org'>"), (202, "ftp://H.NET?x", ""), (203, "x://", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_link_trust_against_sql(ready, seed):
    table = ready.createDataFrame(web(seed), "page_id long, url string, html string")
    with duckdb.connect() as engine:
        pages = table.toPandas()
        engine.register("pages", pages)
        want = sorted(engine.execute(ORACLES["op3_link_trust"]).fetchall())
    found = sorted(tuple(r) for r in links.judge(table).collect())
    assert found == want
    assert {r[4] for r in found if r[3] is None} == {"allow", "block"}


def test_trust_reaches_the_end_of_long_chains(ready):
    # Hosts that link on to a blocked one, over more links than the rounds at least.
    hosts = [f"h{i}.net" for i in range(20)] + ["bad.com"]
    rows = [(i, f"http://{h}/", f"<a href='http://{hosts[i + 1]}/'>") for i, h in enumerate(hosts[:-1])]
    rows += [(20, "http://bad.com/de/1", ""), (21, "http://far.net/", "")]
    found = {r.page_id: r.verdict for r in links.judge(ready.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {**{i: "block" for i in range(21)}, 21: "allow"}


def test_mass_settles(ready):
    draw = random.Random(2)
    pairs = {(draw.randrange(8), draw.randrange(8)): draw.randint(1, 4) for _ in range(20)}
    out = defaultdict(int)
    for (a, _), w in pairs.items():
        out[a] += w
    mass = {0: 0.15 * 3}
    for _ in range(400):
        after = defaultdict(float, {0: 0.15 * 3})
        for (a, b), w in pairs.items():
            after[b] += 0.85 * w / out[a] * mass.get(a, 0.0)
        mass = after
    edges = ready.createDataFrame([(f"{a}", f"{b}", w) for (a, b), w in pairs.items()], "src string, dst string, weight long")
    found = links.propagated(edges, ready.createDataFrame([("0", 3.0)], "host string, seed double")).collect()
    assert {r.host: r.mass for r in found} == pytest.approx({f"{h}": m for h, m in mass.items() if m}, rel=1e-5)


def test_rules(ready):
    urls = {
        "https://example.org/es/5": ("example.org/es/", "block"),
        "https://m.EXAMPLE.org/en/17": ("example.org/en/1", "block"),
        "https://example.org/en/27": ("org/", "allow"),
        "https://notexample.org/es/5": ("org/", "allow"),
        "https://example.org": (None, "allow"),
        "http://a.com/fr/": ("com/fr/", "allow"),
        "http://a.com/de/?x=/fr/": ("com/de/", "block"),
        "http://a.net/de/": (None, "allow"),
        "plain": (None, "allow"),
    }
    table = ready.createDataFrame([(i, u, "", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    rows = {r.page_id: (r.rule, r.verdict) for r in links.judge(table).collect()}
    assert [rows[i] for i in range(len(urls))] == list(urls.values())
    assert links.judge(table.where("false")).collect() == []
