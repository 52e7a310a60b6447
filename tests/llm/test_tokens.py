import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.common import empty, frame, odd_texts, prose
from tokenizers import Tokenizer

from strandlake.llm import packing, token_counts
from strandlake.llm.encode import _WIDE, default_tokenizer, encoder


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(model, text):
    return model.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(model):
    texts = odd_texts() + ["a  b", " a", "a ", "\n", "a \nb", "x\n y", "'s don't  z", "\t\tq", "12 345,6", "'ll 'll\n'll", "a\r\nb"]
    got = []
    for _, count, ids in encoder(default_tokenizer()).column(pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [ids_of(model, t) for t in texts]


def test_encoder_equals_the_tokenizer_on_any_white_space(model):
    rng = random.Random(3)
    parts = [" ", " ", "\n", "\t", "\x00", "\x1c", "a", "hello", "42", "!", "é", "日本", "'s", "<|endoftext|>", "<|endof", "text|>", *_WIDE]
    texts = ["\u00a0", "\u00a0\u00a0hello", "\u00a0\u2003hi", "\u00a0\u0085\x00x", "hi\u3000", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    got = []
    for _, count, ids in encoder(default_tokenizer()).column(pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert [t for t, x in zip(texts, got, strict=True) if x != ids_of(model, t)] == []


def test_every_id_lies_in_one_piece(spark, model):
    texts = odd_texts()
    rows = packing.pack(frame(spark, texts).repartition(3), length=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        whole = b"".join(p.ids for p in pieces)
        assert np.frombuffer(whole, "<u4").tolist() == [*ids_of(model, text), 1]
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert all(p.doc_tokens == len(whole) // 4 for p in pieces)
    last = max(by_sequence)
    for k, pieces in by_sequence.items():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert sum(p.length for p in pieces) == 256 or k == last


def test_packing_of_repeated_null_and_no_rows(spark):
    rows = packing.pack(frame(spark, ["a b", "a b", None], [5, 5, None]), length=4).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 1 and {r.doc_id for r in rows} == {5, None}
    assert packing.pack(empty(spark)).count() == 0


def test_checksum_of_the_query_form(spark, model):
    from pyspark.sql import functions as F

    row = packing.pack(frame(spark, ["hello there"])).select(F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(np.array([*ids_of(model, "hello there"), 1], "<u4").tobytes())


def test_histogram_answers_every_limit(spark, model):
    texts = odd_texts() + [prose(n, n) for n in range(1, 40)]
    lengths = [len(ids_of(model, t)) for t in texts]
    rows = token_counts.length_histogram(token_counts.document_lengths(frame(spark, texts))).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        limit = r.n_tokens
        assert r.n_docs == lengths.count(limit)
        assert r.docs_longer == sum(x > limit for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > limit)
        assert r.truncated_total == sum(min(x, limit) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    assert token_counts.length_histogram(token_counts.document_lengths(empty(spark))).count() == 0
