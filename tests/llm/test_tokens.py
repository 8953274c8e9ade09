import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenar.llm.tokens import DEFAULT_VOCABULARY, PATTERN, count_tokens, encode_column, vocabulary


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary(DEFAULT_VOCABULARY).rank, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="abcdeilnorst' \n.,12ãé", max_size=120))
def test_same_as_the_library(reference, text):
    assert list(vocabulary(DEFAULT_VOCABULARY).encode(text)) == reference.encode_ordinary(text)


def test_long_pieces(reference):
    rnd = random.Random(3)
    words = vocabulary(DEFAULT_VOCABULARY)
    for text in ("a" * 20000, "".join(rnd.choice("abcdefgh") for _ in range(20000)), "=-" * 5000, " " * 5000 + "x", "ção" * 5000, "<|endoftext|>", "🙂" * 3000):
        ids = list(words.encode(text))
        assert ids == reference.encode_ordinary(text)
        assert reference.decode(ids) == text


def test_column(spark, reference):
    rows = [(1, "Olá mundo", "x"), (2, None, "x"), (3, "", "x"), (1, "Olá mundo", "x"), (4, "   ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, other string")
    found = encode_column(df).collect()
    assert sorted((r.doc_id, list(r.ids), r.other or "") for r in found) == sorted((i, reference.encode_ordinary(t) if t else [], o or "") for i, t, o in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df, keep=["doc_id"]).collect()) == sorted((i, len(reference.encode_ordinary(t)) if t else 0) for i, t, _ in rows)
    assert encode_column(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode_column(df, out="other")


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_all_documents_of_the_tables(spark, reference):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    found = encode_column(docs, keep=["doc_id"]).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    assert [r.doc_id for r in found if list(r.ids) != (reference.encode_ordinary(r.text) if r.text else [])] == []
