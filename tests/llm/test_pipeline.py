"""Stages of the pipeline against plain Python, each on its own rows."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from holdfast.llm.queries import WORDS
from plain import brute_components, brute_fingerprint

FIELDS = "doc_id long, text string, source string, n_chars long, key int, f int"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    texts = ["", " ", None, "one", "mail a.b@c.org now", "mail a.b@c.org now ", "plain words"]
    for _ in range(8):
        words = [f"w{k}" for k in rng.integers(0, 300, 150)]
        texts += [" ".join(words), "\n".join(words), " ".join([*words[:70], "other", *words[71:]]), " ".join(words[:80])]
    texts.append("long " * 9000)
    rows = [(90 - i, t, "x", len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, FIELDS).repartition(3)


def test_exact(spark, corpus):
    rows, docs = corpus
    best = {}
    for r in rows:
        name = re.sub("[\x20\x09-\x0D]", "", r[1] or "")
        best[name] = min(best.get(name, r), r, key=lambda x: (-len(x[1] or ""), x[0]))
    got = pipeline.exact(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in best.values())


def test_near(spark, corpus):
    rows, docs = corpus
    prints = [brute_fingerprint(r[1] or "", 3) for r in rows]
    roots = brute_components([r[0] for r in rows], prints, 3)
    got = pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(roots))
    nameless = spark.createDataFrame([(None, "one", "x", 3, 1, 2), (1, "one", "x", 3, 1, 2)], FIELDS)
    assert pipeline.near(spark, nameless, "").count() == 2


def test_personal_data(spark, corpus):
    rows, docs = corpus
    got = {r.doc_id: r for r in pipeline.personal_data(spark, docs, "").collect()}
    assert len(got) == len(rows)
    for i, text, *rest in rows:
        if text and "@" in text:
            assert got[i].text == text.replace("a.b@c.org", "[EMAIL]") and got[i].n_chars == len(got[i].text)
        else:
            assert tuple(got[i]) == (i, text, *rest)


def test_pack(spark, corpus):
    rows, docs = corpus
    library = Tokenizer.from_file(WORDS)
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    taken, places = {i: [] for i in ids}, {}
    for r in pipeline.pack(spark, docs, "").collect():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        taken[r.doc_id].append((r.start, part))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: [x for _, p in sorted(parts) for x in p] for i, parts in taken.items()} == ids
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096


def test_empty(spark, corpus):
    none = corpus[1].where("false")
    for stage in (pipeline.exact, pipeline.near, pipeline.personal_data, pipeline.pack):
        assert stage(spark, none, "").count() == 0
