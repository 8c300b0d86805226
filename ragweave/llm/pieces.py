"""SentencePiece encoding and decoding with a distinct-chunk table.

In a model whose pieces have whitespace markers only at their start, no piece crosses from a
character to a following marker. A text then falls into chunks, a run of markers and the characters
after it, that are segmented independently. Texts are worked on in blocks of ``BLOCK_CHARS``
characters: the distinct chunks of a block make a table, the library segments each of them once,
and ids are joined back by position. A worker keeps the table from block to block while it has at
most ``TABLE_CHUNKS`` entries and never copies it; chunks of over ``LONG_CHUNK`` characters leave it
with their block. So memory is bounded by a block and a table, and nothing is shuffled: a table for
all of a corpus would be as large as its vocabulary, and to join it to every position would shuffle
several times the corpus.

What a chunk decodes to is compared with the chunk when it is segmented. Chunks that decode to
anything else are kept with what they decode to, and texts without any are their own decoding.

A model that doesn't allow this (pieces across markers, other normalisation than the identity, no
dummy prefix, user-defined symbols) is given whole texts instead, with the same results.

Defined results: null is the empty text, which has the end id alone; rows are independent, so ids,
order and repeats don't matter; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_CHUNKS = 100_000
LONG_CHUNK = 64
BLOCK_CHARS = 1_000_000
MARKER = "\u2581"
CHUNK = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")
MODEL = "piece_bpe_32k.model"
#: Per process: path -> Encoder.
_ENCODERS: dict[str, Encoder] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Encoder:
    """Encodes and decodes whole texts as the library does, segmenting each distinct chunk once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.model.eos_id()
        self.by_chunk = self._separable()
        normal = [not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)) for i in range(self.model.get_piece_size())]
        self.surface = [self.model.id_to_piece(i) for i in range(len(normal))]
        self.special = frozenset(i for i, n in enumerate(normal) if not n)
        #: chunk -> its ids, decimal and joined by spaces.
        self.table: dict[str, str] = {}
        #: chunk -> what it decodes to, where that isn't the chunk with spaces for markers.
        self.odd: dict[str, str] = {}

    def _separable(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        rules = spec.normalizer_spec
        plain = rules.name == "identity" and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        leading = not spec.trainer_spec.treat_whitespace_as_suffix and all(MARKER not in p.piece.lstrip(MARKER) for p in spec.pieces)
        bpe = spec.trainer_spec.model_type == proto.TrainerSpec.BPE
        return plain and leading and bpe and spec.trainer_spec.byte_fallback and not any(p.type == p.USER_DEFINED for p in spec.pieces)

    def _segment(self, chunks: list[str]) -> None:
        """Put chunks into the table."""
        marker = self.model.piece_to_id(MARKER)
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)  # the dummy prefix is the marker left out
        ids = [one or [marker] for one in ids]  # a lone marker: the library gives nothing for an empty text
        table, surface, special = self.table, self.surface, self.special
        for chunk, one in zip(chunks, ids, strict=True):
            table[chunk] = " ".join(map(str, one))
            if special.isdisjoint(one) and "".join([surface[i] for i in one]) == chunk.replace(" ", MARKER):
                continue  # normal pieces decode to themselves, with spaces for markers
            back = " " + self.model.decode(one) if len(chunk) > 1 else " "
            if back != chunk.replace(MARKER, " "):
                self.odd[chunk] = back

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids with the end id, their number, decoded text) of each text."""
        if not self.by_chunk:
            ids = [[*x, self.end] for x in self.model.encode(texts, num_threads=1)]
            return [(" ".join(map(str, x)), len(x), self.model.decode(x)) for x in ids]
        cut = [CHUNK.findall(" " + t) if t else [] for t in texts]
        table, odd, end = self.table, self.odd, str(self.end)
        distinct = set().union(*cut)
        missing = [c for c in distinct if c not in table]
        if len(table) + len(missing) > TABLE_CHUNKS:
            table.clear()
            odd.clear()
            missing = list(distinct)
        self._segment(missing)
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            ids = " ".join(map(table.__getitem__, chunks))
            plain = not odd or odd.keys().isdisjoint(chunks)
            back = text.replace(MARKER, " ") if plain else "".join([odd.get(c) or c.replace(MARKER, " ") for c in chunks])[1:]
            out.append((f"{ids} {end}", ids.count(" ") + 2, back) if chunks else (end, 1, ""))
        if len(table) > TABLE_CHUNKS:
            table.clear()
            odd.clear()
        for c in missing:
            if len(c) > LONG_CHUNK:
                table.pop(c, None)
                odd.pop(c, None)
        return out


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[slice]:
    """Slices of consecutive texts of about so many characters in all."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _udf(path: str | None, fields: str, shape):
    """A pandas UDF over texts whose rows are ``shape(ids, n, decoded)``."""

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path or default_model())
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            texts = [t if t is not None else "" for t in batch]
            rows = [shape(*r) for s in _blocks(texts) for r in enc.encode(texts[s])]
            yield pd.DataFrame(rows, columns=names)

    return run


def encoded(text: Column, path: str | None = None) -> Column:
    """A struct of ids (array of int, with the end id) and decoded (the text decoded from them)."""
    return _udf(path, "ids array<int>, decoded string", lambda ids, n, back: ([int(i) for i in ids.split()], back))(text)


def digests(text: Column, path: str | None = None) -> Column:
    """A struct of n_tokens, ids_sha256 and decoded_sha256."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _udf(path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, n, back: (n, sha(ids), sha(back)))(text)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the columns n_tokens, ids_sha256 and decoded_sha256 in place of any of these names."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.select(*keep, digests(F.col("text"), path).alias("__d")).select(*keep, "__d.*")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode_documents(docs.select("doc_id", "text"), path).drop("text")
