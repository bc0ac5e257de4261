import gc
import hashlib
from collections import Counter

import pyarrow as pa
from tokenizers import Tokenizer

from gradelake.llm import bpe, queries, token_counts

TRICKY = [
    "", " ", "Ωραίος ΣΊΣΥΦΟΣ İstanbul ﬁ x²", "a<|endoftext|>b <|startoftext|>", "can't  WON'T've!!'s'tx", "日本語テキスト 😀😀 é é", "\x1c\x1da\x85b c \x00x", "ÿñß×÷ªµ½ erzß", "'sss ''''re 12ab34", "A" * 5000, "٣٤ Ⅷ ²", "naïve Ärger über çédille",
]


def expected(tok, text):
    ids = tok.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids


def test_encodes_as_the_library_does(spark, path, small):
    tok = Tokenizer.from_file(path)
    encoder = bpe.Encoder.of(path)
    for plain in (True, False):
        texts = [t for t in TRICKY if encoder.is_plain(t) == plain]
        got = encoder.encode(pa.array(texts), plain)
        for t, a, b in zip(texts, got.ends, got.ends[1:]):
            assert got.ids()[a:b].tolist() == expected(tok, t)[3], t
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op5_bpe(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(tok, docs[r["doc_id"]])[:3]


def test_cuts_are_certain(path):
    encoder, words = bpe.Encoder.of(path), [b"qzx", b"jqxv", b"wqjz", b"other"]
    parts, n = encoder.fragments(pa.array(words))
    parts = parts.to_pylist()
    assert b"".join(parts) == b"".join(words) and n.tolist()[3] == 1 and max(n) > 1
    for k in range(3):
        own = parts[sum(n[:k]) : sum(n[: k + 1])]
        for left, right in zip(own, own[1:]):
            assert not any(chr(left[-1]) + chr(right[0]) in t for t in encoder.tokens.to_pylist())


def test_slices_change_nothing(spark, odd_docs, path, monkeypatch):
    whole = Counter(bpe.encode_and_decode(odd_docs, path).collect())
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    assert Counter(bpe.encode_and_decode(odd_docs, path).collect()) == whole and gc.isenabled()


def test_odd_rows_and_round_trip(spark, odd_docs, path):
    tok = Tokenizer.from_file(path)
    rows = bpe.encode_and_decode(odd_docs, path, keep_ids=True).collect()
    want = Counter((r["doc_id"], *expected(tok, r["text"] or "")[:3]) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert all(tok.decode(r["ids"], skip_special_tokens=False) == r["decoded"] for r in rows)
    assert bpe.encode_and_decode(odd_docs.limit(0), path).collect() == []


def test_token_counts_answer_every_limit(spark, odd_docs, path):
    tok = Tokenizer.from_file(path)
    n = [len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd_docs.collect()]
    got = {r["context_limit"]: r for r in token_counts.answers(token_counts.histogram(odd_docs, path), width=16).collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r["n_docs"] == n.count(limit) and r["docs_over"] == sum(x > limit for x in n) and r["docs_total"] == len(n) and r["tokens_total"] == sum(n)
        assert r["tokens_over"] == sum(x for x in n if x > limit) and r["truncated_total"] == sum(min(x, limit) for x in n) and r["tokens_lost"] == sum(max(0, x - limit) for x in n)
        assert abs(r["share_within"] - sum(x <= limit for x in n) / len(n)) < 1e-12
    assert token_counts.answers(token_counts.histogram(odd_docs.limit(0), path)).collect() == []
