import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from tokenizers import Tokenizer

from tests.llm import cases
from veilsift.llm.token_files import KEPT_CHARS, LENGTH, ChunkEncoder, read_token_files, sequence, write_token_files

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))


def library(texts):
    t = Tokenizer.from_file(FILE)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def hash_of(text):
    """xxhash64 of a column's value: seed 42, which a null gives back."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_chunks_give_the_librarys_ids():
    texts = ["  a  b ", "\n foo\n\n bar  <|endoftext|> x's 's", " ", "a ", "", None, "a  b　 c", " x", "don't  stop\t now", cases.LONG[:5000], "\x0b \x1c y"]
    encoder = ChunkEncoder.of(FILE, "<u2")
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts), 0)
        want = [x + [0] for x in library(texts)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == sum(want, [])


def test_special_tokens_and_unbroken_texts_are_the_librarys():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y  z", "a <|endoftext|", "q" * 200_000, "ab " + "日本" * 50_000 + " c", "z " * 3 + "y" * 40]
    encoder = ChunkEncoder(FILE, "<u2")
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts), 0)
        want = [x + [0] for x in library(texts)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == sum(want, [])
    assert max(map(len, encoder.known)) <= KEPT_CHARS


def test_files_are_rolled(spark):
    docs = cases.plain(spark, [(i, cases.LONG[: 100 * i]) for i in range(60)])
    whole, rolled = write_token_files(docs, FILE, files=1), write_token_files(docs, FILE, files=1, file_ids=1)
    assert whole.count() == 1 and rolled.count() >= 1
    assert sorted(map(tuple, read_token_files(whole).collect())) == sorted(map(tuple, read_token_files(rolled).collect()))


def test_round_trip_through_files(spark):
    rows = [r[:2] for r in cases.rows()]
    listed = write_token_files(cases.frame(spark), FILE, files=3)
    got = read_token_files(listed).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(r[1]))):
        ids = library([t])[0] + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_random_access_without_a_copy(spark):
    docs = cases.plain(spark, [(i, cases.LONG[i:6000]) for i in range(20)])
    listed = write_token_files(docs, FILE, files=1).collect()
    ids = np.array(sum((x + [0] for x in library([cases.LONG[i:6000] for i in range(20)])), []))
    for k in (0, 3, len(ids) // LENGTH):
        tokens, mask = sequence(listed[0]["path"], k)
        assert not tokens.flags.owndata and len(tokens) == LENGTH
        kept = tokens[np.array(mask.to_pylist())]
        assert kept.tolist() == ids[k * LENGTH : (k + 1) * LENGTH].tolist()


def test_empty_table(spark):
    assert read_token_files(write_token_files(cases.frame(spark, []), FILE)).count() == 0
