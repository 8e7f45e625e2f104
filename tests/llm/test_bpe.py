import base64

import public_tokenizers as P
import tiktoken

from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def _encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_encoder_on_every_code_point():
    v, enc = bpe.Vocabulary.read(PATH, P.PATTERN), _encoding()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 9973):
        for text in ("".join(every[k : k + 997]), " a".join(every[k : k + 997]), "\n ".join(every[k : k + 97]) + "  ", "ab" * 3000):
            ids = v.encode([text])[0]
            assert ids.tolist() == enc.encode_ordinary(text)
            assert v.decode(ids).tobytes() == text.encode()


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h, slots = bpe.PerfectHash.build(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert bpe.PerfectHash.build([b"one"])[1].tolist() == [0]


def test_digest(spark, sf):
    import hashlib

    enc = _encoding()
    rows = [(1, None, 1), (2, "", 1), (3, "x" * 50_000, 2), (4, "don't  stop\n\n été", 2), (4, "don't  stop\n\n été", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    docs = docs.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    want = []
    for i, t in docs.collect():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digest(docs, PATH, P.PATTERN).collect())) == sorted(want)
    assert bpe.digest(docs.limit(0), PATH, P.PATTERN).collect() == []
    assert bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), bpe.vocabulary(spark, PATH, P.PATTERN)).columns == ["doc_id", "text", "ids"]
