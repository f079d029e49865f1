"""The pipeline, stage by stage, against a brute-force version."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_documents import base_by_hand, closure, removed_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from sitemill.llm import gam, nearcopies, packing, simhash, texts

D = "/root/testdata/sf0.001"


def runs_of(text):
    return set(simhash.shingle_hashes((text or "").encode(), 5)[0].tolist())


def groups_by_hand(rows):
    """Positions joined by fingerprints or by the similarity of all pairs."""
    sets = [runs_of(r["text"]) for r in rows]
    prints = [simhash.fingerprint((r["text"] or "").encode(), 5) for r in rows]

    def similar(i, j):
        both = len(sets[i] & sets[j])
        return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4 or (sets[i] and sets[j] and similar(i, j))]
    return closure(range(len(rows)), pairs), pairs


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_near_copies(spark, odd, none, table):
    docs = {"odd": odd, "none": none}.get(table)
    docs = spark.read.parquet(f"{D}/documents.parquet") if docs is None else docs
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    rows = list({(r["doc_id"], r["text"]): r for r in rows}.values())
    names = Counter(r["doc_id"] for r in rows)
    rows = [r for r in rows if names[r["doc_id"]] == 1]
    got = {r["doc_id"]: r["component_key"] for r in nearcopies.near_copies(spark.createDataFrame(rows, docs.schema), "doc_id").collect()}
    want, pairs = groups_by_hand(rows)
    of = {rows[i]["doc_id"]: min(rows[j]["doc_id"] for j in g) for g in want for i in g}
    assert set(got) == set(of)
    # never more than all pairs join, and nearly all of it
    for a in got:
        assert of[a] == of[got[a]]
    joined = [got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]] for i, j in pairs]
    assert not joined or np.mean(joined) >= 0.95


def joined_as_all_pairs(spark, texts_):
    """Groups of near_copies and those of all pairs, over texts by position."""
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts_)]
    got = {r["doc_id"]: r["component_key"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id").collect()}
    want, _ = groups_by_hand(rows)
    return got, {i: min(g) for g in want for i in g}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[int(rng.integers(len(words)))] = f"e{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [4, 32])
def test_copies_edited_independently_join_as_all_pairs_do(spark, monkeypatch, small):
    """No holder of a shared run is left out because the chosen one is unlike it."""
    monkeypatch.setattr(nearcopies, "SMALL", small)
    rng = np.random.default_rng(6)
    texts_ = []
    for _ in range(3):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(60)]
        texts_ += [edited(rng, words, int(rng.integers(1, 4))) for _ in range(60)]
    got, want = joined_as_all_pairs(spark, texts_)
    assert got == want


def test_copies_with_many_edits_of_their_own_make_no_pairs(spark, monkeypatch):
    """A family below the similarity: runs are shared by all, pairs are few."""
    rows = Counter()
    write = nearcopies.Scratch.write

    def counted(self, df, label):
        out = write(self, df, label)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(nearcopies.Scratch, "write", counted)
    rng = np.random.default_rng(11)
    words = [f"w{rng.integers(1 << 40)}" for _ in range(120)]
    texts_ = [edited(rng, words, 4) for _ in range(200)] + [edited(rng, words, 1) for _ in range(20)]
    got, want = joined_as_all_pairs(spark, texts_)
    assert got == want and rows["held"] > 500
    assert rows["candidates"] < 2000  # of 24,090 pairs


def test_groups_joined_by_late_links(spark, monkeypatch):
    """Chains of copies, met in hot runs, whose ends are unlike."""
    monkeypatch.setattr(nearcopies, "SMALL", 2)
    rng = np.random.default_rng(12)
    texts_ = []
    for _ in range(6):
        words = [f"w{rng.integers(1 << 40)}" for _ in range(80)]
        for step in range(12):
            words = [*words]
            words[(step * 7) % 80] = f"e{rng.integers(1 << 40)}"
            texts_.append(" ".join(words))
    got, want = joined_as_all_pairs(spark, texts_)
    assert got == want and len(set(want.values())) < len(texts_)


def test_short_copies_join_as_all_pairs_do(spark):
    """Texts of few runs have candidates too, also if an end is changed."""
    rng = np.random.default_rng(7)
    texts_ = []
    for n in (10, 12, 20, 30):
        for _ in range(20):
            words = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
            texts_ += [" ".join(words), " ".join([*words, "more"]), " ".join(["so", *words])]
    got, want = joined_as_all_pairs(spark, texts_)
    assert got == want


def pipeline_by_hand(spark, folder, docs, rows):
    """What is left after each stage, as rows (doc_id, text)."""
    model = gam.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    x = np.array([texts.features((r["text"] or "").encode()) for r in rows])
    rows = [r for r, s in zip(rows, model.score(x), strict=True) if s >= 0.7]
    yield rows
    rows = [r for r in rows if (c := base_by_hand(r["text"] or ""))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    yield rows
    groups, _ = groups_by_hand(rows)

    def key(i):
        import hashlib

        r = rows[i]
        return r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5((r["text"] or "").encode()).hexdigest()

    rows = [rows[min(g, key=key)] for g in groups]
    yield rows
    cut = removed_by_hand([r["text"] or "" for r in rows], corpus_pipeline.PASSAGE)
    rows = [{"doc_id": r["doc_id"], "text": c[3].decode("utf-8", "ignore")} for r, c in zip(rows, cut, strict=True)]
    yield rows
    lib, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = np.array([*lib.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        out += [(r["doc_id"], s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in packing.cuts(len(ids), 2048, packing.PIECE)]
    yield out


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_stages_by_hand(spark, odd, labels, tmp_path, table):
    folder = D
    if table == "odd":
        folder = str(tmp_path)
        odd.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # too few labels to prove a cutoff, so the rules' base alone decides here
    steps = pipeline_by_hand(spark, folder, docs, docs.collect())
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps, strict=True):
        out = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
        if name == "packing":
            got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out.collect())
            assert got == Counter(want)
        else:
            assert out.dtypes == docs.dtypes
            assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == Counter((r["doc_id"], r["text"] or "") for r in want), name
        docs = out
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_pipeline_of_an_empty_table(spark, none, labels, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {k.split("_")[0] for k in found if k.startswith("op") and k[2].isdigit()} | {"pipeline"} & set(found)
