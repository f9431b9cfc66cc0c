import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from millrace.llm.piececount import PieceCounter, count_pieces, piece_model, unigram_vocabulary


def reference(vocabulary, unknown, by_bytes):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=by_bytes))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text).ids)


VOCAB = unigram_vocabulary(piece_model())
COUNT = reference(*VOCAB)
ODD = ["", " ", "  two  spaces ", "日本語 テキスト", "a\nb\tc", "😀 x😀😀y", "▁x ▁", "ñandú ÀÈ", "x" * 5000, "<s> <unk> <0x41>", "á́"]


def check(text):
    got = PieceCounter.of_sentencepiece(piece_model()).counts([text])[0][0]
    assert got == COUNT(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_documents_and_odd_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").limit(150).collect()}
    for t in ODD:
        check(t)
    got = {r["doc_id"]: r["n_pieces"] for r in count_pieces(docs, piece_model()).collect()}
    assert all(got[d] == COUNT(t) for d, t in texts.items()) and len(got) == docs.count()


def test_ties_and_unknown_runs():
    r = random.Random(1)
    for by_bytes in (False, True):
        pieces = ["<unk>", "▁", *"abc", "ab", "bc", "ca", "abc", "bca", "▁a", "▁ab"]
        scores = [-5.0, -1.0, -1.0, -1.0, -1.0, -2.0, -2.0, -2.0, -3.0, -3.0, -2.0, -3.0]
        vocabulary = list(zip(pieces, scores)) + ([(f"<0x{b:02X}>", -6.0) for b in range(256)] if by_bytes else [])
        counter, count = PieceCounter(vocabulary, 0, by_bytes), reference(vocabulary, 0, by_bytes)
        for _ in range(400):
            text = "".join(r.choice("abcxé ") for _ in range(r.randrange(1, 14)))
            assert counter.counts([text])[0][0] == count(text), (text, by_bytes)


def walked_back(counter, word):
    """The same program with back pointers, whose best path is walked to count its pieces."""
    n = len(word)
    score, start, unknown = [0.0] + [-math.inf] * n, [-1] * (n + 1), [False] * (n + 1)
    pieces = {p: s for p, s in counter.pieces.items() if p}
    for i in range(n):
        for e in range(i + 1, n + 1):
            s = pieces.get(word[i:e])
            if s is not None and score[i] + s > score[e]:
                score[e], start[e], unknown[e] = score[i] + s, i, False
        if word[i] not in pieces and score[i] + counter.unknown_score > score[i + 1]:
            score[i + 1], start[i + 1], unknown[i + 1] = score[i] + counter.unknown_score, i, True
    count, e = 0, n
    while e > 0:
        stop = e
        while e > 0 and unknown[e]:
            e = start[e]
        if e < stop:
            count += counter.unknown_pieces(word[e:stop])
        else:
            count, e = count + 1, start[e]
    return count, score[n]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcxé😀▁", max_size=25), st.booleans(), st.integers(0, 5))
def test_against_walking_back(word, by_bytes, seed):
    r = random.Random(seed)
    pieces = ["<unk>", "▁", *"abc", "ab", "bc", "ca", "abc", "bca", "▁a", "▁ab", "éx"]
    vocabulary = [(p, -float(r.randrange(1, 5))) for p in pieces] + ([(f"<0x{b:02X}>", -6.0) for b in range(256)] if by_bytes else [])
    counter = PieceCounter(vocabulary, 0, by_bytes)
    assert counter.count(word) == walked_back(counter, word)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a b", 0), (3, "a" * 200_000, 0)], "doc_id long, text string, n_pieces int")
    got = sorted((tuple(r)[:2] for r in count_pieces(df, piece_model()).collect()), key=str)
    assert got[0][1] == 0 and got[1][1] == 0 and len(got) == 4
    assert count_pieces(df.limit(0), piece_model()).collect() == []
