"""BPE by the words' trie against the tokenizers library."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintlake.llm.bpe import Vocabulary, decode_documents, encode_documents, vocabulary_file
from lintlake.llm.queries import bpe_query

from .conftest import prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file())


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(vocabulary_file())


def same(vocabulary, library, texts):
    for found, want in zip(vocabulary.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert found.tolist() == want.ids
        assert vocabulary.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_token_is_itself(vocabulary):
    tokens = [t for t in vocabulary.ids if t]
    assert all(found == [vocabulary.ids[word]] for word, found in vocabulary.walk(tokens))


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(vocabulary, library, seed):
    rng = random.Random(seed)
    alphabet = ["a", "a", "b", "e", "s", " ", " ", "\n", "\t", "'s", "é", "日本", "🙂", "12", ".", "!?", "<|endoftext|>", "<|end", "\x00", "\x1c", "\x85", "\xa0", "՘", "\U00011f00", "the", "ing", "​", "ก็"]
    same(vocabulary, library, ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(1500)])


def test_every_character(vocabulary, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(vocabulary, library, ["".join(f"a{chr(c)} {chr(c)}1" for c in points[n::101]) for n in range(101)])


def test_long_words(vocabulary, library):
    rng = random.Random(7)
    same(vocabulary, library, ["a" * 100_000, "ab" * 40_000 + " ab" * 1000, "".join(rng.choices("abcdeé", k=100_000)), " " * 50_000 + "x", "\n" * 9999])


def test_shared_prefixes_are_walked_once(vocabulary):
    """The walk asks about a seam at nodes below the shared prefix only."""
    asked = []
    parted = vocabulary.parted
    vocabulary.parted = lambda left, right: asked.append(1) or parted(left, right)
    try:
        stem = prose(1, 60).encode()
        list(vocabulary.walk([stem]))
        alone, asked[:] = len(asked), []
        list(vocabulary.walk([stem + b"%d" % n for n in range(50)]))
        assert len(asked) < alone + 50 * 8
    finally:
        del vocabulary.parted


def test_odd_documents(spark, odd, library):
    rows = decode_documents(encode_documents(odd.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)))).join(
        odd.select("doc_id", "text").distinct(), ["doc_id"], "left").where("doc_id is not null").collect()
    texts = {(r.doc_id, r.text or "") for r in odd.collect()}
    for r in decode_documents(encode_documents(odd)).collect():
        assert (r.doc_id, r.decoded) in texts and r.ids == library.encode(r.decoded, add_special_tokens=False).ids and r.part == "clash"
    assert rows and decode_documents(encode_documents(odd)).count() == odd.count()
    assert decode_documents(encode_documents(odd.limit(0))).collect() == []


def test_foreign_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 10**9, -1, 220]), (4, [161])], "n int, ids array<int>")
    assert [r.decoded for r in decode_documents(rows).orderBy("n").collect()] == ["", "", "a ", "�"]


def test_lists_are_decoded_together(vocabulary, library):
    lists = [library.encode(t, add_special_tokens=False).ids for t in ("", "añb 日本🙂\n", "<|endoftext|> x", "prose " * 50)]
    lists += [None, [161], [64, None, 10**9, -1, 220], []]
    column = pa.array(lists, pa.list_(pa.int32()))
    for part in (column, column.slice(1, 5), column.slice(4, 1), column.slice(0, 0)):
        assert vocabulary.decode_batch(part) == [vocabulary.decode([i for i in x or () if i is not None]) for x in part.to_pylist()]


def test_query_against_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_query(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert found[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert len(found) == len(docs)
