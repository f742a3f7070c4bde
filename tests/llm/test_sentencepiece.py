import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tests.llm import cases
from veilsift.llm.sentencepiece import SPACE, Pieces, encoded, summaries

FILE = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["  a  b ", "日本語\n\ttab", "\x00 zz", "🙂🙂 é", "a" * 300, " ", "Hello world, this is it.", "Größe été niño", "x" + SPACE + "y"]


@pytest.fixture(scope="module")
def unigram():
    """The library's own search over the same pieces and scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(FILE, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def ids(pieces, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in pieces.encode(texts)]


def test_ids_are_the_librarys(unigram):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcdeé ñ,.\nöth") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    pieces = Pieces.read(FILE)
    got, want = ids(pieces, texts), unigram.encode(texts)
    for a, b, t in zip(got, want, texts):
        if a != b:  # equal totals may be reached in two ways
            assert np.isclose(pieces.scores[a].sum(), pieces.scores[b].sum(), atol=1), t
    assert sum(a == b for a, b in zip(got, want)) > 0.99 * len(texts)


def brute(pieces, word):
    """The best total by trying all segmentations from the left."""
    table = {t: s for t, s, k in zip(pieces.texts, pieces.scores, pieces.kinds) if k == 1}
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 16), end):
            s = table.get(word[start:end], pieces.unknown_score if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_segmentations_are_the_best():
    pieces, rng = Pieces.read(FILE), random.Random(2)
    words = [SPACE + "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(1, 20))) for _ in range(400)]
    for word, raw in zip(words, pieces.segmented(words)):
        found = np.frombuffer(raw, "<i4")
        assert "".join(pieces.texts[i] for i in found) == word
        assert np.isclose(pieces.scores[found].sum(), brute(pieces, word))


def test_decoding_is_exact(spark):
    pieces = Pieces.read(FILE)
    for t, i in zip(TEXTS, pieces.encode(TEXTS)):
        assert pieces.decode(np.frombuffer(i, "<i4")) == t.replace(SPACE, " ")
    out = summaries(cases.frame(spark), FILE).collect()
    assert len(out) == len(cases.rows()) and all(r["round_trip"] for r in out)
    assert {r["n_pieces"] for r in out if r["doc_id"] in (3, 4)} == {0}


def test_ids_come_as_arrays_and_empty_table(spark):
    out = {r["doc_id"]: r["ids"] for r in encoded(cases.frame(spark), FILE).collect()}
    assert out[8] == ids(Pieces.read(FILE), ["short"])[0] and out[3] == []
    assert encoded(cases.frame(spark, []), FILE).count() == 0


def test_a_text_with_the_space_mark_does_not_claim_to_come_back(spark):
    out = {r["doc_id"]: r["round_trip"] for r in summaries(cases.plain(spark, [(1, "x" + SPACE + "y"), (2, "x y")]), FILE).collect()}
    assert out == {1: False, 2: True}


def test_long_words_are_cut_into_blocks_without_loss(monkeypatch):
    from veilsift.llm import sentencepiece as module

    rng, pieces = random.Random(6), Pieces.read(FILE)
    words = ["".join(rng.choice("abcdefghinorst日é") for _ in range(n)) for n in (700, 700, 3000)]
    whole = pieces.segmented(words)
    monkeypatch.setattr(module, "CELLS", 4000)
    assert pieces.segmented(words) == whole
    pieces.encode(["x" * 100_000])
    assert max(map(len, pieces.known)) <= module.KEPT_CHARS
