import random
import time

import pytest
from pyspark.sql import functions as F

from murmuration.llm import tokens

PATH = f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def vocab():
    return tokens.vocabulary(PATH)


def texts():
    rng = random.Random(3)
    alphabets = ["ab", "aaaa", "etaoin shrdlu'st  \n", "0123456789", "é漢字aß ", "hello world's 12 !!'s'll", "-=", "ABCdef123+/", "\x1c\x85 　 a", "👍🏽é"]
    for _ in range(200):
        yield "".join("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(1, 5)))


def test_blocks_give_what_the_whole_text_gives(vocab):
    for text in texts():
        for block in (4, 7, 50):
            assert tokens.encode_text(vocab, text, block) == vocab.encoding.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 4000, "-" * 4000, "the" * 1500, "你好" * 1000, "abcdefghij" * 300, "́" * 1500, " " * 3000 + "x", "'" * 900 + "s" * 900])
def test_pieces_longer_than_a_block(vocab, text):
    assert tokens.encode_text(vocab, text, 64) == vocab.encoding.encode_ordinary(text)


def test_memory_within_a_piece_is_bounded(vocab):
    stream = tokens.PieceStream(vocab)
    for _ in range(200):
        stream.push(b"abcdefghij" * 20)
        assert len(stream.data) <= 8 * vocab.lookahead


RUNS = [("foo\n", "acgt"), ("foo\t", "a"), ("foo'", "the"), ("''", "s"), ("x", " "), ("x", "\n"), ("x", " \t"), ("", "0123456789"), ("!", "-"), ("a", "你好")]


@pytest.mark.parametrize(("before", "unit"), RUNS)
def test_what_is_held_is_bounded_whatever_precedes_a_run(vocab, before, unit):
    text = before + unit * (20_000 // len(unit)) + "x 's"
    stream, ids, held = tokens.StreamingEncoder(vocab, 256), [], 0
    for i in range(0, len(text), 100):
        ids += stream.push(text[i : i + 100])
        held = max(held, stream.held())
    assert ids + stream.finish() == vocab.encoding.encode_ordinary(text)
    assert held <= 256 + 9 * vocab.lookahead


@pytest.mark.parametrize(("before", "unit"), [("foo\n", "acgt"), ("x", " "), ("", "word and 12 more\n")])
def test_time_is_linear_in_the_text(vocab, before, unit):
    def took(n):
        text, began = before + unit * (n // len(unit)), time.perf_counter()
        assert tokens.encode_text(vocab, text)
        return time.perf_counter() - began

    took(10_000)
    assert took(3_000_000) < 25 * max(took(300_000), 0.02)


def test_test_documents_in_blocks(vocab):
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        assert tokens.encode_text(vocab, text) == (vocab.encoding.encode_ordinary(text) if text else [])


def test_equals_the_other_library(vocab):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in [*texts(), "<|endoftext|> is text", "naïve  \t\n x"]:
        assert tokens.encode_text(vocab, text, 20) == other.encode(text, add_special_tokens=False).ids


def test_corpus_round_trip_nulls_and_long_text(spark, monkeypatch):
    long = "a long text, with words 12 and lines\n" * 20_000
    rows = [(1, "hello"), (2, None), (3, ""), (4, long), (5, "<|endoftext|>"), (None, "x"), (1, "hello"), (6, " \n"), (7, "漢字👍")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit(1), "id": F.lit("x")})
    encoded = tokens.encode_corpus(df)
    got = [(r["doc_id"], r["ids"]) for r in encoded.collect()]
    assert len(got) == len(rows) and dict(got)[2] == [] and dict(got)[3] == []
    back = sorted((r["doc_id"] or 0, r["text"]) for r in tokens.decode_corpus(encoded).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_decoding_waits_for_whole_characters(vocab):
    ids = vocab.encoding.encode_ordinary("a👍🏽é漢")
    state = tokens.StreamingDecoder(vocab)
    parts = [state.push([i]) for i in ids]
    assert "".join(parts) + state.finish() == "a👍🏽é漢" and "�" not in "".join(parts)
