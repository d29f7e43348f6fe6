"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed and its normaliser, metaspace marker, scores
(or merges) and byte fallback are rebuilt as a ``tokenizers.Tokenizer``.
Batches are encoded multithreaded, and every encoded chunk is held against
the sentencepiece library itself; a rebuilt decoder turns ids into text.

Unigram scores are summed in double precision here and in single precision by
the library, so in long texts it may take another of two segmentations whose
scores differ by less than single precision tells; parity is false then.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from millrace.llm.util import batches, texts

MARK = "▁"
LETTER, TAIL = "[A-Za-zÀ-ɏ]", "[.,!*$%&#]"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def parse(path: str):  # noqa: ANN201
    """The model's protobuf message."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges(scores: dict[str, float]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score of the third first."""
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in scores and right in scores:
                found.append((-score, cut, left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def normaliser(rule, *, prefix: bool = True):  # noqa: ANN001, ANN201
    """The model's normaliser, with or without the marker that it puts before a text."""
    from tokenizers import Regex, normalizers

    steps = []
    if rule.precompiled_charsmap:
        steps.append(normalizers.Precompiled(rule.precompiled_charsmap))
    if rule.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(x), by) for x, by in (("\\A +", ""), (" {2,}", " "), (f"[ {MARK}]+\\z", ""))]
    if rule.add_dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def rebuild(path: str):  # noqa: ANN201
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the sentencepiece model does.

    In a unigram model only normal and user pieces may match a text. The
    others get a blank behind their names, which no normalised text holds, so
    that text such as ``<s>`` stays text; ``ids_of`` writes their bytes.
    """
    from tokenizers import AddedToken, Tokenizer, decoders, models

    proto = parse(path)
    trainer, rule = proto.trainer_spec, proto.normalizer_spec
    vocab = {p.piece: i for i, p in enumerate(proto.pieces)}
    unk = next((p.piece for p in proto.pieces if p.type == UNKNOWN), None)
    if trainer.model_type == BPE:
        scores = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER)}
        model = models.BPE(vocab, merges(scores), unk_token=unk, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) if p.type in (NORMAL, USER) else (p.piece + " ", 0.0) for p in proto.pieces], vocab[unk], byte_fallback=False)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    made = Tokenizer(model)
    made.normalizer = normaliser(rule)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    made.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * bool(rule.add_dummy_prefix))
    if own := [AddedToken(p.piece, normalized=True) for p in proto.pieces if p.type == USER]:
        made.add_tokens(own)
    return made


class Decoder:
    """Texts from ids by the rebuilt decoder, which is asked once for every piece.

    Pieces decode each for itself, but for runs of byte pieces, which are
    decoded as they come. Unknown and control pieces are no text to it: the
    library writes a sign for the one and nothing for the other.
    """

    def __init__(self, path: str):
        from tokenizers import decoders

        proto = parse(path)
        self.names, self.strip = [p.piece for p in proto.pieces], proto.normalizer_spec.add_dummy_prefix
        steps = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])  # the first blank is stripped of whole texts only
        self.decoder = steps.decode
        self.table = [" ⁇ " if p.type == UNKNOWN else "" if p.type in (CONTROL, BYTE) else self.decoder([p.piece]) for p in proto.pieces]
        self.byte = np.array([p.type == BYTE for p in proto.pieces])
        self.lone = {i for i, p in enumerate(proto.pieces) if p.piece == MARK} if proto.normalizer_spec.remove_extra_whitespaces else set()

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4")
        while len(found) and int(found[0]) in self.lone:  # a model without extra blanks drops all of them in front
            found = found[1:]
        byte = self.byte[found]
        parts = list(map(self.table.__getitem__, found.tolist()))
        if byte.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], byte, [False]]).astype(np.int8))).reshape(-1, 2)
            for a, b in edges.tolist():
                parts[a] = self.decoder([self.names[i] for i in found[a:b].tolist()])
        text = "".join(parts)
        return text[1:] if self.strip and text[:1] == " " else text


class Codec:
    """Encodes texts by chunks that no piece can cross, each encoded once per worker.

    If no piece holds the marker after another character, a text's pieces are
    those of its runs of markers and what follows; if no piece holds a line
    feed, lines are apart too; if none holds a letter before a common
    punctuation mark, words are apart from the marks behind them. Where the model does not allow this, texts are
    encoded whole. At most two generations of ``size`` chunks are kept.
    """

    def __init__(self, path: str, size: int = 150_000):
        import sentencepiece

        self.proto, self.tokenizer = parse(path), rebuild(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        rule, pieces = self.proto.normalizer_spec, [p.piece for p in self.proto.pieces if p.type in (NORMAL, USER)]
        plain = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.add_dummy_prefix
        apart = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
        user = any(p.type == USER for p in self.proto.pieces)
        blank = f"[ {MARK}]"
        word = "" if any(re.search(f"{LETTER}{TAIL}", p) for p in pieces) else f"{blank}*{LETTER}+(?={TAIL}|{blank}|\n|$)|"
        self.cut = re.compile(f"\n|{word}{blank}*[^ {MARK}\n]+|{blank}+").findall if plain and apart and not user else None
        # A text's first marker is a blank put before it; chunks are normalised without one.
        self.normaliser = normaliser(rule, prefix=not self.cut)
        self.tokenizer.normalizer = None
        self.unk = next((i for i, p in enumerate(self.proto.pieces) if p.type == UNKNOWN), -1)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(self.proto.pieces) if p.type == BYTE} if self.proto.trainer_spec.byte_fallback and self.proto.trainer_spec.model_type == UNIGRAM else {}
        self.size, self.new, self.old = size, {}, {}

    def ids_of(self, encoding, text: str) -> list[int]:  # noqa: ANN001
        """Its ids, where unknown characters of a unigram model are written as byte pieces."""
        ids = encoding.ids
        if not self.bytes or self.unk not in ids:
            return ids
        return [i for one, (a, b) in zip(ids, encoding.offsets, strict=True) for i in ([self.bytes[x] for x in text[a:b].encode()] if one == self.unk else [one])]

    def learn(self, chunks: set[str]) -> None:
        missing = [c for c in chunks if c not in self.new]
        if len(self.new) + len(missing) > self.size:
            self.old, self.new = self.new, {}
            missing = list(chunks)
        todo = []
        for c in missing:
            if (hit := self.old.get(c)) is not None:
                self.new[c] = hit
            else:
                todo.append(c)
        if self.cut:  # no chunk but the line feed itself holds one, so all are normalised in one text
            named = [c for c in todo if c != "\n"]
            made = dict(zip(named, self.normaliser.normalize_str("\n".join(named)).split("\n"), strict=True)) if named else {}
            plain = [made.get(c, c) for c in todo]
        else:
            plain = [self.normaliser.normalize_str(c) for c in todo]
        got = (self.tokenizer.encode_batch if self.bytes else self.tokenizer.encode_batch_fast)(plain, add_special_tokens=False)
        if self.cut:  # the library adds the first marker itself
            alike = [c if c == "\n" else c[1:] or None if c[0] == MARK else None for c in plain]
        else:
            alike = todo
        held = iter(self.processor.encode([a for a in alike if a not in (None, "\n")], num_threads=1))
        for c, n, a, e in zip(todo, plain, alike, got, strict=True):
            ids = self.ids_of(e, n)
            if a == "\n":
                same = ids == [self.proto_id("<0x0A>")]
            elif a is None:  # a chunk after a line feed: held with a marker that belongs to the line feed
                other = self.processor.encode("\n" + n)
                same = ids == other[other.index(self.proto_id("<0x0A>")) + 1 :] if self.proto_id("<0x0A>") in other else False
            else:
                same = ids == next(held)
            self.new[c] = (array("I", ids).tobytes(), same)

    def proto_id(self, piece: str) -> int:
        return self.processor.piece_to_id(piece)

    def encode(self, many: list[str]) -> list[tuple[bytes, bool]]:
        """(little-endian uint32 ids, whether every chunk agrees with the sentencepiece library) of each text."""
        if self.cut:
            parts = [self.cut(" " + t) if t else [] for t in many]
        else:
            parts = [[t] if t else [] for t in many]
        self.learn(set().union(*parts))
        out = []
        for chunks in parts:
            hits = list(map(self.new.__getitem__, chunks))
            out.append((b"".join([h[0] for h in hits]), all([h[1] for h in hits])))
        return out


_CODECS: dict[str, Codec] = {}
_DECODERS: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    """One decoder for each Python worker, kept from task to task."""
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def codec(path: str, threads: int = 2) -> Codec:
    """One codec for each Python worker, kept from task to task."""
    os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(threads))
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), text_crc32, parity: one row for each input row.

    Null and empty texts have no ids. Parity says that all chunks of the text
    got the ids that the sentencepiece library gives; where no piece can cross
    their ends, those are the text's ids. Whole texts are encoded, however
    long. Repeated rows and rows with a null id each give a row; other columns,
    whatever their names, are not read. There is no shuffle.
    """
    import zlib

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for batch in batches(stream, 128):
            many = batch.column(1).to_pylist()
            got = own.encode(many)
            cols = [pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([zlib.crc32(t.encode()) for t in many], pa.int64()), pa.array([p for _, p in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], ["doc_id", "n_tokens", "ids", "text_crc32", "parity"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, text_crc32 long, parity boolean")


def decode(df: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """The input with a column ``decoded``: the text of its ids. Null ids give an empty text.

    An input column of that name is replaced; repeated rows each give a row, an
    empty table none.
    """
    df = df.drop("decoded")

    names, at = [*df.columns, "decoded"], df.columns.index(ids_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in batches(stream, 128):  # texts leave the task as they are made
            texts = [own.decode(i) if i is not None else "" for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", StringType())]))
