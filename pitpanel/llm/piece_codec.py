"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed and rebuilt: normaliser (precompiled character
map, white-space rules), metaspace marker, and, by the model's kind, unigram
scores or the merges that piece scores of a BPE model imply, with byte fallback.
Batches are encoded by the library's threads, and the result is held against the
sentencepiece library: every pre-token a worker has not met is encoded by both,
and where they differ the sentencepiece ids count (a column tells how often).

A text is cut before each run of spaces that follows another character. No
piece of the vocabulary has a marker behind another character (checked when the model is
loaded; a model that has is encoded text by text), so no piece crosses a cut.

Defined results: null text counts as empty and has no tokens; null ids stay null; repeated
rows give repeated results; an empty table gives no rows; other columns are
ignored. Control symbols inside a text are plain text, as in sentencepiece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import plain, portions, record

#: Parameters: threads of the tokenizers library in one Python worker, and pre-tokens a worker remembers.
THREADS = 2
MEMO_ENTRIES = 250_000

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def bpe_merges(scores: dict[str, float]) -> list[tuple[str, str]]:
    """The merges that piece scores imply: each way to cut a piece in two pieces, better pieces first."""
    found = []
    for piece, score in scores.items():
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in scores and right in scores:
                found.append((-score, len(found), left, right))
    found.sort()
    return [(left, right) for _, _, left, right in found]


class PieceCodec:
    """Both libraries with one model."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = proto.ModelProto()
        with open(path, "rb") as f:
            self.model.ParseFromString(f.read())
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokenizer = self._rebuilt()
        spec = self.model.normalizer_spec
        pieces = [p.piece for p in self.model.pieces if p.type in (NORMAL, USER)]
        # what a cut before spaces needs: nothing joins across it and nothing removes or adds spaces
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces) and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and self.model.trainer_spec.model_type == BPE
        self.prefix = " " if spec.add_dummy_prefix else ""
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode() for p in self.model.pieces]

    def _rebuilt(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        spec, kind = self.model.normalizer_spec, self.model.trainer_spec
        pieces = [(p.piece, p.score) for p in self.model.pieces]
        unknown = next(i for i, p in enumerate(self.model.pieces) if p.type == UNKNOWN)
        if kind.model_type == UNIGRAM:
            model = models.Unigram(pieces, unknown, kind.byte_fallback)
        elif kind.model_type == BPE:
            scores = {p.piece: p.score for p in self.model.pieces if p.type in (NORMAL, USER)}
            vocab = {p: i for i, (p, _) in enumerate(pieces)}
            model = models.BPE(vocab, bpe_merges(scores), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=kind.byte_fallback)
        else:
            raise ValueError(f"model type {kind.model_type} is neither unigram nor BPE")
        tokenizer = Tokenizer(model)
        steps = []
        if spec.precompiled_charsmap:
            steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if spec.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        tokenizer.normalizer = normalizers.Sequence(steps)
        # one word per run of markers and what follows: the dummy prefix comes with the text
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else [])])
        return tokenizer

    def cut(self, text: str) -> list[str]:
        """The text, with its dummy prefix, in parts that are encoded on their own."""
        if not text:
            return []
        whole = self.prefix + text
        if not self.cuts:
            return [whole]
        if "  " not in whole:
            first, *rest = whole.split(" ")
            return ([first] if first else []) + [" " + x for x in rest]
        return re.findall(" +[^ ]*|[^ ]+", whole)

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of parts by the tokenizers library in one batch, and whether sentencepiece agrees; where not, its ids."""
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        # sentencepiece puts the prefix before a part itself, but not before an empty one
        known = self.reference.encode([p[len(self.prefix) :] for p in parts], num_threads=1)
        known = [[self.reference.piece_to_id(MARK)] if self.prefix and p == self.prefix else k for p, k in zip(parts, known, strict=True)]
        same = [a == b for a, b in zip(ours, known, strict=True)]
        return [a if s else b for a, b, s in zip(ours, known, same, strict=True)], same

    def gives_back(self, ids: bytes, text: str) -> bool:
        """Whether the pieces of all ids of a document spell its text, behind the prefix."""
        spelt = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return spelt == (self.prefix + text).encode() if text else not spelt

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=True)


ENCODED = "doc_id long, ids binary, n_tokens long, n_differ long"
DECODED = "doc_id long, text string"


class Memo:
    """Bounded map from pre-token to a value, in two generations; a batch's misses are made together. `marked` holds keys of note, as bounded."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size
        self.new: dict = {}
        self.old: dict = {}
        self.marked: set = set()
        self.marked_old: set = set()

    def marks(self, words: list[str]) -> int:
        """How many of the words are marked."""
        if self.marked_old:
            self.marked.update(w for w in words if w in self.marked_old)
        return sum(map(self.marked.__contains__, words)) if self.marked else 0

    def need(self, texts: list[list[str]]) -> dict:
        """A dictionary that holds all pre-tokens of the batch."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
            self.marked_old, self.marked = self.marked, set()
        new, old, missing = self.new, self.old, {}
        for words in texts:
            for w in [w for w in words if w not in new]:
                v = old.get(w)
                if v is None:
                    missing[w] = None
                else:
                    new[w] = v
        words = list(missing)
        for i in range(0, len(words), 4096):
            new.update(zip(words[i : i + 4096], self.make(words[i : i + 4096]), strict=True))
        return new


class Encoder:
    """A worker's codec with its memo of pre-tokens."""

    def __init__(self, path: str, threads: int = THREADS):
        self.codec = PieceCodec(path, threads)
        self.memo = Memo(self._make, MEMO_ENTRIES)

    def _make(self, parts: list[str]) -> list[bytes]:
        ids, same = self.codec.encode(parts)
        self.memo.marked.update(p for p, s in zip(parts, same, strict=True) if not s)
        return [np.array(x, "<u4").tobytes() for x in ids]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of each text, and in how many pre-tokens the libraries differ."""
        parts = [self.codec.cut(t) for t in texts]
        known = self.memo.need(parts)
        ids = [b"".join(map(known.__getitem__, p)) for p in parts]
        return ids, [self.memo.marks(p) for p in parts]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.codec.decode([np.frombuffer(x, "<u4").tolist() for x in ids])


def encode(docs: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """doc_id, ids (little-endian, 32 bits), n_tokens, and in how many pre-tokens the two libraries differ."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, threads)
        for batch in portions(batches):
            ids, differ = encoder.encode(batch.column("text").to_pylist())
            yield record(doc_id=batch.column("doc_id"), ids=ids, n_tokens=[len(x) // 4 for x in ids], n_differ=differ)

    return plain(docs, "doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, threads)
        for batch in portions(batches, "ids"):
            yield record(doc_id=batch.column("doc_id"), text=encoder.decode(batch.column("ids").to_pylist()))

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """One row per document: its tokens, the checksum of its ids, in how many pre-tokens the libraries differ, and whether decoding all its ids returns the text.

    The ids of every document are spelt out by the bytes of their pieces; `decode` does it by the tokenizers library.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, threads)
        for batch in portions(batches):
            texts = batch.column("text").to_pylist()
            ids, differ = encoder.encode(texts)
            back = list(map(encoder.codec.gives_back, ids, texts))
            yield record(doc_id=batch.column("doc_id"), n_tokens=[len(x) // 4 for x in ids], ids_crc32=list(map(zlib.crc32, ids)), n_differ=differ, decoded_equal=back)

    return plain(docs, "doc_id", "text").mapInArrow(run, ROUND)


ROUND = "doc_id long, n_tokens long, ids_crc32 long, n_differ long, decoded_equal boolean"
