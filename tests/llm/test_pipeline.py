"""The stages of the pipeline on odd tables, and the whole of it against plain loops."""

import hashlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import brute_contamination, grouped, prose, shingles, shuffled, similarity
from tokenizers import Tokenizer

import corpus_pipeline
from proseloom.llm import lines
from proseloom.llm.queries import TOXIC_SCORE, scored_texts

SF = "/root/testdata/sf0.001"
KEPT = corpus_pipeline.STAGES[:-1]


def folder(ready, path, documents, items=()):
    documents.write.parquet(f"{path}/documents.parquet")
    ready.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    ready.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture
def strange(ready, odd, tmp_path):
    """The odd table with columns that the operators use themselves."""
    named = odd.withColumns({"n_removed": F.lit(77), "n_lines": F.lit(5), "item_id": F.lit(1), "kept": F.lit(False), "class_id": F.lit(9), "text_hash": F.lit(3)})
    return named, folder(ready, tmp_path, named, [(1, "Text without an id stands here on its own"), (None, "x"), (2, None)])


@pytest.mark.parametrize("stage", [fn for _, fn in KEPT], ids=[name for name, _ in KEPT])
def test_stages_keep_columns_and_clean_rows(ready, strange, stage):
    docs, path = strange
    out = stage(ready, docs, path)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all((r.n_removed, r.n_lines, r.score, r.class_id, r.kept) == (77, 5, 0.5, 9, False) for r in rows)
    ids = sorted(r.doc_id or -1 for r in rows)
    everything = sorted(r.doc_id or -1 for r in docs.collect())
    if stage is corpus_pipeline.near_duplicate:
        # One of the copies 1 and 2, and every row without an id.
        assert ids == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    elif stage is corpus_pipeline.decontamination:
        # Of the rows without an id only the one that holds the item goes.
        assert ids == everything[1:] and not any(r.text and r.text.startswith("Text without") for r in rows)
    else:
        assert ids == everything
    empty = stage(ready, docs.where("false"), path)
    assert empty.columns == docs.columns and empty.collect() == []


def test_last_stage_and_empty_run(ready, strange, tmp_path):
    docs, path = strange
    assert corpus_pipeline.bpe(ready, docs, path).count() == docs.count()
    assert corpus_pipeline.bpe(ready, docs.where("false"), path).collect() == []
    nothing = folder(ready, tmp_path / "nothing", docs.where("false"))
    assert corpus_pipeline.run(ready, nothing).collect() == []


def test_only_contaminated_rows_of_an_id_go(ready, tmp_path):
    import random

    draw = random.Random(3)
    item = prose(draw, 30)
    rows = [(None, f"{prose(draw, 20)} {item}"), (None, prose(draw, 40)), (5, item), (5, prose(draw, 30)), (6, None)]
    docs = ready.createDataFrame(rows, "doc_id long, text string")
    path = folder(ready, tmp_path, docs, [(1, item)])
    left = corpus_pipeline.decontamination(ready, docs, path).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted((d or 0, t or "") for d, t in rows if item not in (t or ""))


def test_clean_rows_are_not_shuffled_for_contaminated_ones(ready, tmp_path):
    import random

    draw = random.Random(44)
    item = prose(draw, 40)
    rows = [(i, " ".join(f"{draw.getrandbits(32):x}" for _ in range(600)) + (f" {item}" if i % 100 == 7 else "")) for i in range(1500)]
    path = folder(ready, tmp_path, ready.createDataFrame(rows, "doc_id long, text string"), [(1, item)])
    ready.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    before = shuffled(ready)
    left = corpus_pipeline.decontamination(ready, ready.read.parquet(f"{path}/documents.parquet"), path).collect()
    assert sorted(map(tuple, left)) == [r for r in rows if r[0] % 100 != 7]
    assert shuffled(ready) - before < 0.2 * sum(len(text) for _, text in rows)
    # A batch of the reader holds whole texts.
    assert int(ready.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256


def test_short_pages_lose_their_header_and_footer(ready):
    rows = [(i, f"Header of all sites, quite long\nown {i}\nFooter of all sites, longer than the page", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, "a copy\nfrom site to site", f"s{i}") for i in range(9)]
    found = lines.remove_boilerplate(ready.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found} == {
        **{i: (f"own {i}", 3, 2) for i in range(24)},
        **{100 + i: ("a copy\nfrom site to site", 2, 0) for i in range(9)},
    }


def test_run_equals_plain_loops(ready):
    docs = ready.read.parquet(f"{SF}/documents.parquet")
    scores = scored_texts(docs, ready.read.parquet(f"{SF}/labels.parquet"), ["doc_id", "text", "source"], "toxicity")
    left = {r.doc_id: (r.text, r.source) for r in scores.where(F.col("toxicity") < TOXIC_SCORE).collect()}
    with duckdb.connect() as engine:
        documents = ready.createDataFrame([(d, t, s) for d, (t, s) in left.items()], "doc_id long, text string, source string").toPandas()
        engine.register("documents", documents)
        texts = {r[0]: r[1] for r in engine.execute(f"SELECT doc_id, text FROM ({lines.LINES_SQL})").fetchall()}
    ids = sorted(texts)
    sets = {d: shingles(texts[d]) for d in ids}
    pairs = []
    for k, b in enumerate(ids):
        for a in ids[:k]:
            small, large = sorted((sum(sets[a].values()), sum(sets[b].values())))
            if (texts[a] and texts[a] == texts[b]) or (small >= 0.8 * large and similarity(sets[a], sets[b]) >= 0.8):
                pairs.append((a, b))
    classes = grouped(ids, pairs)
    kept = [d for d in ids if classes[d] == d]
    items = [(r.item_id, r.text) for r in ready.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for i, item in items:
        wanted = set(shingles(item))
        near = [(d, texts[d]) for d in kept if len(wanted & set(sets[d])) >= 0.5 * len(wanted)]
        bad |= {d for d, _ in brute_contamination(near, [(i, item)])}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d in kept:
        if d not in bad:
            found = library.encode(texts[d] or "", add_special_tokens=False).ids
            want[d] = hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
    rows = corpus_pipeline.run(ready, SF).collect()
    assert {r.doc_id: r.ids_sha256 for r in rows} == want and bad and len(kept) < len(ids)
