"""Encoding with a public byte-level BPE vocabulary, as a streaming transducer with bounded lookahead.

Every text, whatever its length, is read in blocks. Between blocks the encoder keeps only what may still change:

* The splitting pattern always ends a piece where white space follows other characters, and where the class of
  character (letter, number, other) changes, contractions aside. Text before the last such place in a block is
  final, and what is kept is less than a block.
* A block without such a place lies within one piece (a run of one class or of white space, which may be of any
  length), and BPE itself is cut. Tokens that stand side by side in an encoding are the encoding of their joined
  bytes, and a row of tokens is the encoding of a text exactly if that holds for all neighbours. So each prefix of
  the bytes has one last token, and a token is stable once the last tokens of all prefixes within the longest
  token's length, which is the merge list's sufficient lookahead, trace back to it.

Memory is bounded by the block and the longest token, not by the text or its runs. Decoding is an incremental state
machine from bytes to characters.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files; a parameter of every operator here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Characters of a block: most documents are several.
BLOCK_CHARS = 1 << 10
#: Most ids of one Arrow batch that goes back to Spark.
BATCH_IDS = 1 << 20
# Fixed value: the splitting pattern of the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ranks of a vocabulary file of lines ``base64 rank``, and the encoder for whole pieces."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.lookahead = max(map(len, self.ranks))
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._joins: dict[tuple[int, int], bool] = {}

    @cached_property
    def automaton(self) -> object:
        """Finds all tokens that end at each byte (a byte is a character of Latin-1), longest first."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), (len(token), rank))
        found.make_automaton()
        return found

    def follows(self, left: int | None, right: int) -> bool:
        """Whether the tokens can stand side by side: whether they are the encoding of their joined bytes. With
        nothing on the left, whether the token is the encoding of its own bytes."""
        if left is None:
            return self._merge(self.bytes_of[right]) == [right]
        key = (left, right)
        if key not in self._joins:
            if len(self._joins) > 1 << 20:
                self._joins.clear()
            self._joins[key] = self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self._joins[key]

    def _merge(self, data: bytes) -> list[int]:
        """BPE of a few bytes: join the neighbours of lowest rank, leftmost first, as long as there are any."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PieceStream:
    """Encodes one piece whose bytes arrive bit by bit, holding about ``8 * lookahead`` of them.

    ``last[i]`` is the last token of the encoding of the first ``i + 1`` held bytes; ``context`` is the token
    before the held bytes. A later prefix extends one that ends within the last ``lookahead`` bytes. If all of
    these pass through one token end, so do all later ones, and what lies before it is final.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.data, self.last, self.context = vocab, bytearray(), [], None

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 4 * self.vocab.lookahead
        for begin in range(0, len(data), step):
            self._extend(data[begin : begin + step])
            if len(self.data) >= step:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self._tokens(len(self.data))
        self.data, self.last, self.context = bytearray(), [], None
        return out

    def _extend(self, data: bytes) -> None:
        """The last token for each new byte: the one of those ending there that may follow what is before it."""
        old = len(self.data)
        self.data += data
        self.last += [None] * len(data)
        begin = max(0, old - self.vocab.lookahead)
        last, follows, done = self.last, self.vocab.follows, -1
        # Of the tokens that end at a byte the automaton gives the longest first.
        for at, (length, token) in self.vocab.automaton.iter(self.data[begin:].decode("latin-1")):
            end = begin + at
            start = end + 1 - length
            if end < old or end == done or start < 0:
                continue
            before = last[start - 1] if start else self.context
            if (before is not None or (not start and self.context is None)) and follows(before, token):
                last[end], done = token, end

    def _ends(self, end: int) -> list[int]:
        ends = []
        while end > 0:
            ends.append(end)
            end -= len(self.vocab.bytes_of[self.last[end - 1]])
        return ends[::-1]

    def _tokens(self, end: int) -> list[int]:
        return [self.last[e - 1] for e in self._ends(end)]

    def _stable(self) -> list[int]:
        """Tokens up to the last end that all prefixes within the lookahead have in common: of their ends the largest
        is led back by its token until one is left."""
        n = len(self.data)
        ends = set(range(max(1, n - self.vocab.lookahead + 1), n + 1))
        at = n
        while len(ends) > 1:
            while at not in ends:
                at -= 1
            ends.remove(at)
            ends.add(at - len(self.vocab.bytes_of[self.last[at - 1]]))
        cut = ends.pop()
        if not cut:
            return []
        out = self._tokens(cut)
        self.context = out[-1]
        del self.data[:cut], self.last[:cut]
        return out


def _kind(c: str) -> str:
    # Python counts four separators as white space that the pattern does not.
    return "L" if c.isalpha() else "N" if c.isalnum() else "S" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else "O"


# Where a run of each class ends, and the last place in a block where white space follows an ASCII character.
_RUN_ENDS = {kind: regex.compile(f"[{members}]") for kind, members in (("L", r"^\p{L}"), ("N", r"^\p{N}"), ("O", r"\s\p{L}\p{N}"), ("S", r"\S"))}
_BLANK_CUT = regex.compile(r"(?r)(?<=[!-~])(?=[ \t\r\n])")
_PIECES = regex.compile(PATTERN)


def safe_cut(text: str) -> int:
    """The last place in a block at which a piece ends whatever follows, or 0 if there is none."""
    found = _BLANK_CUT.search(text)
    if found is not None and found.start():
        return found.start()
    for i in range(len(text) - 1, 0, -1):
        a, b = _kind(text[i - 1]), _kind(text[i])
        if a != "S" and (b == "S" or (a != b and text[i - 1] != "'")):
            return i
    return 0


class StreamingEncoder:
    """Encodes a text that arrives in parts; ``push`` gives the ids that are final, ``finish`` the rest.

    The parts may be cut anywhere. What is held between calls is less than a block, or, within a run of one
    class or of white space that fills a block, about eight times the lookahead.
    """

    def __init__(self, vocab: Vocabulary, block: int = BLOCK_CHARS) -> None:
        self.vocab, self.block, self.rest, self.piece = vocab, max(block, 4), "", None

    def push(self, part: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(part), self.block):
            out += self._push(part[i : i + self.block])
        return out

    def held(self) -> int:
        """Characters or bytes that wait for what follows."""
        return len(self.rest) + (len(self.piece.data) if self.piece is not None else 0)

    def _push(self, part: str) -> list[int]:
        out: list[int] = []
        self.rest += part
        if self.piece is not None:
            out += self._continue()
        if self.piece is None and len(self.rest) > self.block:
            cut = safe_cut(self.rest)
            if cut:
                out += self.vocab.encoding.encode_ordinary(self.rest[:cut])
                self.rest = self.rest[cut:]
            if len(self.rest) > self.block:
                out += self._open()
        return out

    def _open(self) -> list[int]:
        """Begin to cut the piece that reaches the end of the block. Where it begins is certain, since all pieces
        before it end at a character that is known; the last three may still become part of a contraction."""
        pieces = [m.span() for m in _PIECES.finditer(self.rest)]
        out: list[int] = []
        for begin, end in pieces[:-1]:
            if end > len(self.rest) - 3:
                break
            out += self.vocab.encoding.encode_ordinary(self.rest[begin:end])
        else:
            begin = pieces[-1][0]
        run, self.rest = self.rest[begin:], ""
        if len(run) < 4 or begin != pieces[-1][0]:
            self.rest = run
            return out
        self.piece, self.kind = PieceStream(self.vocab), _kind(run[-1])
        if self.kind == "S":  # the last blank of a run belongs to what follows
            run, self.rest = run[:-1], run[-1]
        return out + self.piece.push(run.encode())

    def _continue(self) -> list[int]:
        found = _RUN_ENDS[self.kind].search(self.rest)
        n = len(self.rest) if found is None else found.start()
        keep = n - (self.kind == "S")
        out = self.piece.push(self.rest[:keep].encode())
        if found is not None:
            out += self.piece.finish()
            self.piece = None
        self.rest = self.rest[keep:]
        return out

    def finish(self) -> list[int]:
        if self.piece is not None:  # only blanks are left beside a piece, and without a follower they belong to it
            out = self.piece.push(self.rest.encode()) + self.piece.finish()
        else:
            out = self.vocab.encoding.encode_ordinary(self.rest) if self.rest else []
        self.piece, self.rest = None, ""
        return out


def encode_text(vocab: Vocabulary, text: str | None, block: int = BLOCK_CHARS) -> list[int]:
    """Ids of one text by the streaming encoder; null and empty give an empty list."""
    stream = StreamingEncoder(vocab, block)
    return stream.push(text or "") + stream.finish()


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col, ids array<int>``: one row for each row of ``documents``, in one pass without a shuffle.

    Strings that look like special tokens are ordinary text. A null and an empty text give an empty list, a null
    id stays null, and repeated rows give repeated rows. Other columns are not read. The file with the vocabulary,
    in ``tokenizer_dir``, must be on every executor; it is read once a Python worker.
    """
    path = os.path.join(tokenizer_dir, tokenizer)
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids, flat, ends, begin = batch.column(0), [], [0], 0
            for i, text in enumerate(batch.column(1)):
                flat += encode_text(vocab, text.as_py())
                ends.append(len(flat))
                if len(flat) >= BATCH_IDS or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, i + 1 - begin), lists], schema=schema)
                    flat, ends, begin = [], [0], i + 1

    return rows.mapInArrow(encode, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


class StreamingDecoder:
    """Turns ids into text as they arrive; bytes of an unfinished character wait for the rest of it."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.vocab.bytes_of[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col, text``: the inverse of ``encode_corpus``; an empty or null list gives an empty text. An id that
    the vocabulary lacks raises an error."""
    path = os.path.join(tokenizer_dir, tokenizer)
    rows = encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                state = StreamingDecoder(vocab)
                texts.append(state.push(ids.as_py() or []) + state.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(decode, "id bigint, text string").withColumnRenamed("id", id_col)
