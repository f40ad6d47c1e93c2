"""Operator 7: SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The model is a byte-pair SentencePiece model (no normalisation but the escaped blanks and the leading one).
Its segmentation of a text is the one path through the lattice of pieces on which every two successive pieces
would also stay as they are if they stood alone: a path is as good as its worst joint, and each prefix of a
text has one best last piece.  That is the forward table of a Viterbi search.  The distinct marked words of a
batch are sorted, which is the depth-first order of their trie, and the search goes on from the prefix that a
word shares with the one before it.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shared import kept, table
from weft.session import ship_package

MARK = "▁"
#: Words up to this length stay in a worker's memory, and so many of them at most.
KEEP_CHARS, KEEP_WORDS = 64, 200_000
#: Characters of text that are worked on at a time.
CHUNK_CHARS = 4 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> list[tuple[str, float, int]]:
    """The (piece, score, type) rows of a model file; an error for models of another kind."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if train.model_type != train.BPE or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
        raise ValueError("a byte-pair model with byte fallback, a leading blank and no other normalisation is needed")
    if any(p.type in (4, 5) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    return [(p.piece, p.score, p.type) for p in proto.pieces]


@dataclass
class Pieces:
    """Encoder and decoder over the rows of ``read_model``."""

    rows: list[tuple[str, float, int]]
    _steps: dict = field(default_factory=dict)
    _joints: dict = field(default_factory=dict)
    _words: dict = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.rows) if kind == 1}
        self.rank = {p: -s for p, s, kind in self.rows if kind == 1}
        by_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.rows) if kind == 6}
        self.byte_ids = [by_byte[b] for b in range(256)]
        # pieces as paths from their last character, to find those that end at a place
        self.ends: dict = {}
        for p in self.ids:
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        # a character that no longer piece holds, and that no piece can join, ends a word as a blank begins one
        breaks = "" if any("\n" in p for p in self.ids) else "\n"
        self.word = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|{breaks}" if breaks else ""))
        self.spelt = [bytes([int(p[3:5], 16)]) if kind == 6 else p.encode() if kind == 1 else b"" for p, _, kind in self.rows]
        self.is_byte = np.array([kind == 6 for _, _, kind in self.rows])

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that build a piece, in their order: rank, first and last symbol after it; None if others win."""
        if piece in self._steps:
            return self._steps[piece]
        symbols, out = list(piece), []
        while len(symbols) > 1:
            r, i = min((self.rank.get(symbols[i] + symbols[i + 1], np.inf), i) for i in range(len(symbols) - 1))
            if r == np.inf:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            out.append((r, symbols[0], symbols[-1]))
        self._steps[piece] = out if len(symbols) == 1 else None
        return self._steps[piece]

    def stays(self, a: str, b: str) -> bool:
        """Whether ``a + b`` is encoded as these two pieces: no merge across the joint comes first."""
        if (known := self._joints.get((a, b))) is not None:
            return known
        left, right = self._merges(a), self._merges(b)
        ok = left is not None and right is not None
        if ok:
            i = j = 0
            x, y = a[-1], b[0]
            while True:
                cross = self.rank.get(x + y, np.inf)
                l = left[i][0] if i < len(left) else np.inf
                r = right[j][0] if j < len(right) else np.inf
                if l == r == cross == np.inf:
                    break
                if l <= cross and l <= r:
                    x, i = left[i][2], i + 1
                elif cross <= r:
                    ok = False
                    break
                else:
                    y, j = right[j][1], j + 1
        self._joints[(a, b)] = ok
        return ok

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each distinct word, in sorted order, going on from the prefix shared with the one before."""
        last, before = [""], ""
        for w in sorted(set(words)):
            n = 0
            for x, y in zip(before, w):  # noqa: B905
                if x != y:
                    break
                n += 1
            del last[n + 1 :]
            for i in range(n + 1, len(w) + 1):
                node, found, at = self.ends, [], i
                while at and (node := node.get(w[at - 1])) is not None:
                    at -= 1
                    if "" in node:
                        found.append((at, node[""]))
                best = w[i - 1]
                for at, p in reversed(found):
                    if self.stays(last[at], p) if at else self._merges(p) is not None:
                        best = p
                        break
                last.append(best)
            out, i = [], len(w)
            while i:
                out.append(last[i])
                i -= len(last[i])
            yield w, out[::-1]
            before = w

    def _ids_of(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out.extend([self.byte_ids[b] for b in p.encode("utf-8")] if i is None else [i])
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        marked = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        own: dict = {}
        for w, pieces in self.segment({w for ws in marked for w in ws if w not in self._words}):
            (self._words if len(w) <= KEEP_CHARS else own)[w] = self._ids_of(pieces)
        if own:
            out = [b"".join([own[w] if w in own else self._words[w] for w in ws]) for ws in marked]
        else:
            out = [b"".join(map(self._words.__getitem__, ws)) for ws in marked]
        if len(self._words) > KEEP_WORDS:
            self._words.clear()
        if len(self._joints) > 2 * KEEP_WORDS:
            self._joints.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        whole = b"".join(map(self.spelt.__getitem__, ids.tolist())).replace(MARK.encode(), b" ")
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def _pieces(rows) -> Pieces:
    return kept(f"pieces-{len(rows.value)}-{hash(tuple(rows.value[-3:]))}", lambda: Pieces(rows.value))


def _chunks(texts: list, most: int) -> Iterator[tuple[int, int]]:
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_texts(df: DataFrame, text: str = "text", model: str | None = None, out: str = "piece_ids", check: str | None = None) -> DataFrame:
    """``df`` with the array ``out`` of piece ids, and with ``check`` a boolean: whether decoding them gives the text.

    Null and empty texts have no ids.  U+2581 in a text is read as a blank, as the model does; decoding gives a
    blank.  Columns of these names are replaced.  The vocabulary, whose size is the model's, is broadcast.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = spark.sparkContext.broadcast(read_model(model or default_model()))
    keep = [c for c in df.columns if c not in (out, check)]
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(rows)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in _chunks(texts, CHUNK_CHARS):
                own = [t or "" for t in texts[a:b]]
                ids = pieces.encode(own)
                offsets = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                columns = [*batch.slice(a, b - a).columns, pa.ListArray.from_arrays(pa.array(offsets), values)]
                if check:
                    same = (pieces.decode(np.frombuffer(x, dtype=np.int32)) == t.replace(MARK, " ") for x, t in zip(ids, own, strict=True))
                    columns.append(pa.array(list(same), type=pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, out, *[check] * bool(check)])

    schema = df.select(*keep).withColumn(out, F.array(F.lit(0)))
    schema = schema.withColumn(check, F.lit(True)) if check else schema
    return df.select(*keep).mapInArrow(run, schema.schema)


def decode_ids(df: DataFrame, ids: str = "piece_ids", model: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` with the text ``out`` of an array of piece ids; null gives null."""
    spark = df.sparkSession
    ship_package(spark)
    rows = spark.sparkContext.broadcast(read_model(model or default_model()))

    @F.pandas_udf("string")
    def text_of(col):
        import pandas as pd

        pieces = _pieces(rows)
        return pd.Series([None if x is None else pieces.decode(np.asarray(x, dtype=np.int32)) for x in col], dtype=object)

    return df.withColumn(out, text_of(F.col(ids)))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces and round_trip (decoding gives the text again) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_texts(docs, check="round_trip")
    return found.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")
