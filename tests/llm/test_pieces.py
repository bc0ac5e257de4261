import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gradelake.llm import pieces, queries


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.of(queries.tokenizer_path("piece_bpe_32k.model"))


def expected(model, text):
    ids = model.model.encode(text or "")
    decoded = model.model.decode(ids)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_texts_of_odd_characters(model):
    rng = random.Random(1)
    alphabet = "  \t\n▁abcxyz.é日😀\x00<>0A　 ́e"
    texts = ["", " ", "  ", "▁", "a", " a", "a ", "a  b", "▁a▁ b", "<s>x</s><unk><0x41>", "日本 語", "ab" * 4000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    one_space = [t for t in texts if "  " not in t.replace("▁", " ") and t[:1] not in (" ", "▁")]
    assert model.splits
    for some in (texts, one_space):
        e = model.encode(pa.array(some))
        ids, decoded = e.ids(), model.decode(e.ids(), e.ends)
        for k, t in enumerate(some):
            want = model.model.encode(t)
            assert ids[e.ends[k] : e.ends[k + 1]].tolist() == want, t
            assert decoded[k].decode() == model.model.decode(want), t


def test_decoding_any_ids(model):
    rng = random.Random(2)
    rows = [[rng.randrange(32_000 if rng.random() < 0.5 else 300) for _ in range(rng.randrange(12))] for _ in range(2000)]
    rows += [[35], [35, 30, 10988], [28705], [28705, 28705], [1, 2, 0]]
    ends = np.cumsum([0, *map(len, rows)])
    got = model.decode(np.array(sum(rows, []), np.uint32), ends)
    assert [t.decode() for t in got] == [model.model.decode(r) for r in rows]


def test_each_chunk_is_segmented_once(model):
    asked = []

    class Spy:
        def __getattr__(self, name):
            return getattr(model.model, name)

        def encode(self, names, **more):
            asked.extend(names)
            return model.model.encode(names, **more)

    own = pieces.Pieces.__new__(pieces.Pieces)
    own.__dict__ = model.__dict__ | {"model": Spy()}
    own.encode(pa.array(["one two one", "two  one", "one"] * 50))
    assert sorted(asked) == [" one", "one", "two"]


def test_query_and_odd_rows(spark, small, odd_docs, model, monkeypatch):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op12_sentencepiece(spark, small).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:] == expected(model, docs[r["doc_id"]]) for r in got)
    want = Counter((r["doc_id"], *expected(model, r["text"])) for r in odd_docs.collect())
    for at_once in (pieces.AT_ONCE, 50):
        monkeypatch.setattr(pieces, "AT_ONCE", at_once)
        rows = pieces.encode_and_decode(odd_docs, path, keep_ids=True).collect()
        assert Counter(tuple(r)[:4] for r in rows) == want
        assert all(model.model.decode(r["ids"]) == r["decoded"] for r in rows)
    assert pieces.encode_and_decode(odd_docs.limit(0), path).collect() == []
    solid = spark.createDataFrame([(1, "日本語" * 100_000), (2, "ab" * 200_000)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in pieces.encode_and_decode(solid, path).collect()} == {
        expected(model, r["text"]) for r in solid.collect()
    }
