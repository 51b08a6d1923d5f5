"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as the protobuf it is, and its parts are rebuilt: the normaliser, the
metaspace marker for blanks, the pieces with their scores (a unigram lattice, or merges in the
order of scores for a BPE model), and byte fallback for characters without a piece. Batches are
encoded by the library's threads. Every task compares its first ``CHECKED_TEXTS`` texts
with the sentencepiece library and fails on a difference; a difference in later texts only is not seen.

The model is read on the driver and sent to the tasks (its size is checked); each Python worker
builds the tokenizer once. Texts go through in slices of bounded length, so memory does not grow
with the batch. Cases: a NULL text has no ids and decodes to NULL; '' has no ids and decodes to
''; a very long text is one slice; equal rows give equal rows; an empty table gives no rows; the
other columns of the input stay, whatever their names. A text that holds the marker U+2581 itself
decodes to blanks there, as in the original library; ``round_trip`` tells.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
SLICE_CHARS = 1 << 20
CHECKED_TEXTS = 8
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def parse(model: bytes):
    """The model's protobuf message."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    message = schema.ModelProto()
    message.ParseFromString(model)
    kind = message.trainer_spec.model_type
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    if any(p.type == USER for p in message.pieces):
        raise ValueError("user-defined pieces are not supported")
    if message.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("white space as suffix is not supported")
    return message


def merges_of(message) -> list[tuple[str, str]]:
    """Pairs to merge, best score first: every cut of a piece into two known pieces."""
    place = {p.piece: i for i, p in enumerate(message.pieces) if p.type == NORMAL}
    single = {c for piece in place for c in piece} - set(place)
    if single:
        raise ValueError(f"characters without a piece of their own: {sorted(single)[:5]}")
    found = []
    for piece, i in place.items():
        cuts = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
        found += [
            (-message.pieces[i].score, place[a], place[b], a, b) for a, b in cuts if a in place and b in place
        ]
    found.sort()
    return [(a, b) for *_, a, b in found]


def normaliser(spec):
    from tokenizers import Regex, normalizers

    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_whitespaces else " "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def build(model: bytes):
    """A tokenizer with the ids of the model."""
    from tokenizers import Tokenizer, decoders, models

    message = parse(model)
    pieces, fallback = message.pieces, message.trainer_spec.byte_fallback
    unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    if message.trainer_spec.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unknown, fallback)
    else:
        core = models.BPE(
            vocab={p.piece: i for i, p in enumerate(pieces)}, merges=merges_of(message),
            unk_token=pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback,
        )
    made = Tokenizer(core)
    made.normalizer = normaliser(message.normalizer_spec)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if message.normalizer_spec.add_dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    made.decoder = decoders.Sequence(steps)
    return made


_BUILT: dict[str, object] = {}


def _built(model: bytes):
    name = hashlib.sha256(model).hexdigest()
    if name not in _BUILT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        _BUILT[name] = build(model)
    return _BUILT[name]


def check_parity(tokenizer, model: bytes, texts: list[str]) -> None:
    """Raise unless the sentencepiece library gives the same ids and the same decoded texts."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        if ids != other.encode(text):
            raise ValueError(f"ids differ from the sentencepiece library for {text[:80]!r}")
        if tokenizer.decode(ids, skip_special_tokens=False) != other.decode(ids):
            raise ValueError(f"decoded text differs from the sentencepiece library for {text[:80]!r}")


def slices(texts: Iterable[str | None], most: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """Runs of texts of at most ``most`` characters in all, or of one text."""
    run, size = [], 0
    for text in texts:
        n = len(text or "")
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += n
    if run:
        yield run


def read_model(path: str) -> bytes:
    """The bytes of a model on the driver's machine; at most ``MAX_MODEL_BYTES``."""
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is over {MAX_MODEL_BYTES} bytes")
    return model


def encode_decode(
    df: DataFrame, text: str = "text", model_path: str = MODEL_PATH, ids: str = "ids",
    fallback: str = "n_fallback", round_trip: str = "round_trip",
) -> DataFrame:
    """``df`` without ``text``, with its ids, the count of byte pieces, and whether decoding
    the ids gives the text back (NULL for a NULL text)."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    message = parse(model.value)
    is_byte = np.array([p.type == BYTE for p in message.pieces])
    others = [c for c in df.columns if c != text]
    # the text under a name of its own, first, so that other names cannot clash
    given = df.select(F.col(text), *(F.col(f"`{c}`") for c in others))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    added = [f"`{ids}` array<int>", f"`{fallback}` long", f"`{round_trip}` boolean"]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, checked = _built(model.value), False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not checked and texts:
                first = [t for t in texts[:CHECKED_TEXTS] if t]
                check_parity(tokenizer, model.value, first)
                checked = True
            at = 0
            for some in slices(texts):
                known = [t or "" for t in some]
                found = [e.ids for e in tokenizer.encode_batch_fast(known, add_special_tokens=False)]
                back = tokenizer.decode_batch(found, skip_special_tokens=False)
                sizes = np.fromiter(map(len, found), np.int32, len(found))
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[flat])])
                rest = [c.slice(at, len(some)) for c in batch.columns[1:]]
                same = [None if t is None else t == b for t, b in zip(some, back, strict=True)]
                made = [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(bytes_before[offsets[1:]] - bytes_before[offsets[:-1]], pa.int64()),
                    pa.array(same, pa.bool_()),
                ]
                names = [*others, ids, fallback, round_trip]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=names)
                at += len(some)

    return given.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", model_path: str = MODEL_PATH, name: str = "text") -> DataFrame:
    """``df`` with the text of its ids in column ``name``; NULL for NULL ids."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    def text_of(x) -> str | None:
        if x is None:
            return None
        return _built(model.value).decode([int(i) for i in x], skip_special_tokens=False)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(text_of)

    return df.withColumn(name, F.pandas_udf(texts, "string")(F.col(ids)))
