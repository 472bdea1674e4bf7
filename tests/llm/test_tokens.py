import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proseloom.llm import bpe, token_counts
from proseloom.llm.lexicon import Lexicon, compile_lexicon
from proseloom.llm.merges import MergeModel
from proseloom.llm.queries import QUERIES, bpe_digests

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
POOL = [*"abcdeEThisn't'llre  \n\té", "the ", "ing", "'s ", "'re", "<|endoftext|>", "<|startoftext|>", "<|endo", "Σ", "İ"]
POOL += ["é", "́", "한", "ᄒ", "ᅡ", "ᆫ", "≠", "漢", "😀", "123", "½", "!!", "\x1c", "　", "\xa0", "\xad"]


def pieces(seed, count, size):
    draw = random.Random(seed)
    for _ in range(count):
        yield "".join(draw.choice(POOL) for _ in range(draw.randint(0, size)))


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(MergeModel.load(WORD))


@pytest.fixture(scope="module")
def library():
    return {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def ids(library, path, text):
    return library[path].encode(text, add_special_tokens=False).ids


def test_every_prefix_has_the_count_of_the_library(counter, library):
    for text in pieces(1, 300, 12):
        counts = np.cumsum(np.frombuffer(counter.steps(text), "<i4"))
        assert counts.tolist() == [len(ids(library, WORD, text[: i + 1])) for i in range(len(text))], text


def test_whole_counts_equal_the_last_prefix(counter, library):
    for text in [*pieces(2, 500, 20), "q" * 5000, "ab" * 3000 + "'s", "漢字" * 2000, "x" * 63 + " " + "x" * 65]:
        assert counter.count(text) == len(ids(library, WORD, text)) == np.frombuffer(counter.steps(text), "<i4").sum()


def test_ranks_rise_as_tokens_grow():
    model = MergeModel.load(WORD)
    made = {}
    for (left, right), rank in model.ranks.items():
        assert made.get(left, -1) < rank and made.get(right, -1) < rank
        made.setdefault(left + right, rank)


def test_memory_bounds_do_not_change_counts(library, monkeypatch):
    for name in ("KEPT_CHUNKS", "KEPT_PREFIXES"):
        monkeypatch.setattr(token_counts, name, 3)
    small = token_counts.PrefixCounter(MergeModel.load(WORD))
    for text in pieces(3, 100, 20):
        assert small.count(text) == len(ids(library, WORD, text))
        assert np.frombuffer(small.steps(text), "<i4").sum() == len(ids(library, WORD, text))


def test_count_tokens_on_odd_rows(odd, nothing, library):
    rows = token_counts.count_tokens(odd, WORD, keep_prefixes=True)
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, len(r.prefixes) // 4) for r in rows.collect())
    want = sorted(
        (r.doc_id or -1, len((r.text or "").encode()), len(ids(library, WORD, r.text or "")), len(r.text or "")) for r in odd.collect()
    )
    assert found == want
    assert token_counts.count_tokens(nothing, WORD).collect() == []


def test_budget_questions(odd, library):
    rows = token_counts.count_tokens(odd, WORD, keep_prefixes=True)
    rows = rows.select("doc_id", token_counts.tokens_before(F.col("prefixes"), F.lit(9)).alias("head"), token_counts.longest_prefix(F.col("prefixes"), F.lit(5)).alias("fits"))
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id IS NOT NULL").collect()}
    for row in rows.where("doc_id IS NOT NULL").collect():
        text = texts[row.doc_id]
        assert row.head == len(ids(library, WORD, text[:9]))
        assert len(ids(library, WORD, text[: row.fits])) <= 5
        assert row.fits == len(text) or row.fits >= 40 or len(ids(library, WORD, text[: row.fits + 1])) > 5


def test_questions_read_bounded_pieces(odd, library, monkeypatch):
    rows = token_counts.count_tokens(odd, WORD, keep_prefixes=True).where("doc_id IS NOT NULL")
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id IS NOT NULL").collect()}
    for length in (0, 255, 256, 300, 9_999_999):
        asked = token_counts.tokens_before(F.col("prefixes"), F.lit(length), F.col("counts"))
        for row in rows.select("doc_id", asked.alias("head"), "counts", "n_tokens").collect():
            assert row.head == len(ids(library, WORD, texts[row.doc_id][:length]))
            assert len(row.counts) == len(texts[row.doc_id]) // token_counts.EVERY


def test_query_stores_every_prefix(odd, library, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id IS NOT NULL").collect()}
    rows = QUERIES["op6_token_counts"](odd.sparkSession, str(tmp_path)).where("doc_id IS NOT NULL").collect()
    assert len(rows) == 11
    for row in rows:
        text, counts = texts[row.doc_id], [0, *np.cumsum(np.frombuffer(row.prefixes, "<i4")).tolist()]
        assert len(counts) == len(text) + 1
        assert row.n_tokens == counts[-1] == len(ids(library, WORD, text)) and row.over_limit == (counts[-1] > 2048)
        for end in {0, 1, len(text) // 3, len(text) // 2, max(0, len(text) - 1)} & set(range(len(text))):
            assert counts[end] == len(ids(library, WORD, text[:end]))


def test_prefixes_are_sent_in_bounded_batches(odd, monkeypatch):
    whole = sorted(map(str, token_counts.count_tokens(odd, WORD, keep_prefixes=True).collect()))
    monkeypatch.setattr(token_counts, "SENT_BYTES", 1)
    assert sorted(map(str, token_counts.count_tokens(odd.repartition(1), WORD, keep_prefixes=True).collect())) == whole


def test_lexicon_finds_exactly_its_words(tmp_path):
    model = MergeModel.load(BYTE)
    words = sorted({w.encode() for t in pieces(4, 400, 6) for w in bpe.WORD.findall(t)} | {b" the", b" then", b"the", b"t"})
    path = tmp_path / "lexicon.bin"
    path.write_bytes(compile_lexicon((w, model.ids(w)) for w in words))
    lexicon = Lexicon(str(path))
    assert [np.frombuffer(ids, "<i4").tolist() for ids in lexicon.find(words)] == [model.ids(w) for w in words]
    longer = [w + b"z" for w in words if w + b"z" not in set(words)]
    shorter = [w[:-1] for w in words if w[:-1] not in set(words)]
    assert set(lexicon.find([*longer, *shorter, b""])) == {None}
    # Endings are shared: far fewer nodes than letters.
    assert len(lexicon.finals) < sum(map(len, words)) / 2
    path.write_bytes(compile_lexicon([]))
    assert Lexicon(str(path)).find([b"a", b""]) == [None, None]


def test_both_ways_of_merging_agree():
    model, draw = MergeModel.load(BYTE), random.Random(6)
    for _ in range(500):
        parts = model.symbols(draw.choice(["abc the ing ", "aaaa", "éèà", "x y"]).encode() * draw.randint(1, 12))
        assert model.merge(parts) == model._merge_long(parts)


def test_encode_and_decode_as_the_library(odd, nothing, library):
    lexicon = bpe.build_lexicon(odd, BYTE, 20)
    found = bpe.decode(bpe.encode(odd, BYTE, lexicon), BYTE).collect()
    own = library[BYTE]
    want = sorted((r.doc_id or -1, ids(library, BYTE, r.text or ""), r.text or "") for r in odd.collect())
    assert sorted((r.doc_id or -1, list(r.ids), r.text) for r in found) == want
    assert all(own.decode(i, skip_special_tokens=False) == t for _, i, t in want)
    assert bpe_digests(nothing).collect() == []


def test_pieces_round_trip(ready, library):
    texts = [*pieces(5, 300, 20), "a" * 3000, "<|endoftext|>" * 3]
    table = ready.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe_digests(table).collect():
        want = ids(library, BYTE, texts[row.doc_id])
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        decoded = library[BYTE].decode(want, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_decode_of_broken_and_null_ids(ready):
    byte = MergeModel.load(BYTE).vocab["Ã"]
    table = ready.createDataFrame([(1, [byte]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(table, BYTE).collect()} == {1: "�", 2: None, 3: ""}
