"""SentencePiece BPE ids without merging whole texts: backtracking over longest matches.

A list of pieces is the merge result of a text exactly when every piece merges to itself and every two
neighbours stay apart when their joined text is merged anew. So the encoder walks the text with the
longest piece at each place (an Aho-Corasick automaton gives all matches in one pass), falls back to
that piece's longest prefix that is a piece too, and steps back when no prefix stays apart from its left
neighbour; places where a walk failed are kept in a field of bits and never tried again. The test of
two neighbours re-merges at most two pieces, and its answers are kept.

The model's own rules stand around that: a space mark before the text and in place of each space, and
bytes for characters that no piece has. Where no piece goes on behind a space mark that follows another
character, texts are cut there, and each distinct stretch is encoded once in a worker (a bounded cache
that only saves time). ``decode`` is the library's.

Null texts are empty and give no ids. A row with a null id is encoded like any other; repeated ids stay
separate rows. Texts of any length, with or without blanks, are encoded whole in time linear in their
length but for the steps back. Columns beside id and text never reach the operator.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import batches, id_text, table

SPACE_MARK = "▁"
_CODECS: dict[str, PieceCodec] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Ids of texts for a byte-fallback BPE model with identity normalisation and a space mark in front.

    Inside, a piece is its number in ``names``; two numbers behind them stand for a character that no piece
    has and for the start of a text.
    """

    def __init__(self, path: str, most_stretches: int = 250_000, most_pairs: int = 1_000_000):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most_stretches, self.most_pairs = most_stretches, most_pairs
        if model.normalize("  áＡ ") != f"{SPACE_MARK * 3}áＡ{SPACE_MARK}":
            raise ValueError("the model changes characters before it encodes, or doesn't mark the start")
        self.ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.names = [model.id_to_piece(k) for k in self.ids]
        self.scores = {p: model.get_score(k) for p, k in zip(self.names, self.ids)}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        number = {p: k for k, p in enumerate(self.names)}
        self.foreign, self.start, self.width = len(self.names), len(self.names) + 1, len(self.names) + 2
        self.sizes = [*map(len, self.names), 1, 0]
        # A piece's longest proper prefix that is a piece, or -1; a character without a piece is spelled by bytes.
        self.shorter = [next((number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in number), -1) for p in self.names] + [-1, -1]
        held = {c for p in self.names for c in p}
        stranger = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in held)
        self.spelled = [*self.names, stranger, ""]
        self.matches = ahocorasick.Automaton()
        for p, k in number.items():
            self.matches.add_word(p, k)
        self.matches.make_automaton()
        self.cuts_at_marks = "\n" not in held and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in self.names)
        self.fitting: dict[int, int] = {}
        self.stretches: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        scores = self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether two neighbours are what merging their joined text gives; of the start, whether ``right`` merges to itself."""
        pair = [self.spelled[k] for k in (left, right) if k != self.start]
        return self.merged("".join(pair)) == pair

    def fit(self, left: int, piece: int) -> int:
        """The piece, or its longest prefix, that stays apart from its left neighbour; -1 if none does."""
        key = left * self.width + piece
        while piece >= 0 and not self.stays_apart(left, piece):
            piece = self.shorter[piece]
        if len(self.fitting) >= self.most_pairs:
            self.fitting.clear()
        self.fitting[key] = piece
        return piece

    def pieces(self, text: str) -> list[int]:
        """Pieces of a stretch whose spaces are marked already; characters that no piece has stand alone."""
        if not text:
            return []
        size, sizes, width, shorter = len(text), self.sizes, self.width, self.shorter
        longest = [self.foreign] * size
        for end, piece in self.matches.iter(text):  # ends rise, so the last match of a place is its longest
            longest[end - sizes[piece] + 1] = piece
        fitting, fit, failed = self.fitting.get, self.fit, bytearray((size >> 3) + 1)
        taken: list[int] = []
        at, left, piece = 0, self.start, longest[0]
        while True:
            found = fitting(left * width + piece)
            piece = fit(left, piece) if found is None else found
            if piece >= 0:
                end = at + sizes[piece]
                if failed[end >> 3] >> (end & 7) & 1:
                    piece = shorter[piece]
                else:
                    taken.append(piece)
                    if end == size:
                        return taken
                    at, left, piece = end, piece, longest[end]
                    continue
            if piece < 0:
                # Nothing fits here after the pieces taken so far: take the last one back and try its prefixes.
                if not taken:
                    raise ValueError("the model's pieces can't spell this text")
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= sizes[piece]
                left = taken[-1] if taken else self.start

    def _ids(self, stretch: str) -> list[int]:
        pieces, ids = self.pieces(stretch), self.ids
        if self.foreign not in pieces:
            return [ids[k] for k in pieces]
        out, at = [], 0
        for k in pieces:
            out += [self.byte_ids[b] for b in stretch[at].encode()] if k == self.foreign else [ids[k]]
            at += self.sizes[k]
        return out

    def _learn(self, key: str) -> bytes:
        """Packed ids of one stretch: with its space marks, behind a line feed (which no piece holds), or a plain word."""
        first = key[:1]
        ids = self._ids(key) if first == SPACE_MARK else self.byte_ids[10:11] + self._ids(key[1:]) if first == "\n" else self._ids(SPACE_MARK + key)
        packed = self.stretches[key] = np.array(ids, np.int32).tobytes()
        return packed

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.cuts_at_marks:
            return np.array(self._ids(SPACE_MARK + text.replace(" ", SPACE_MARK)), np.int32)
        if len(self.stretches) >= self.most_stretches:
            self.stretches.clear()
        if "  " in text or text[0] == " " or SPACE_MARK in text:
            keys = RUNS(SPACE_MARK + text.replace(" ", SPACE_MARK))
        else:  # a single space begins each word but the first, which the mark in front begins
            keys = text.replace("\n", " \n").split(" ")
        known, learn = self.stretches.get, self._learn
        return np.frombuffer(b"".join([known(key) or learn(key) for key in keys]), np.int32)


#: A run of space marks with what follows, or a line feed with what follows.
RUNS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}\n]*|\n[^{SPACE_MARK}\n]*").findall


def codec(path: str) -> PieceCodec:
    """One codec in each worker process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded), one row for each input row: the ids of the whole text and the text they stand for."""
    model = model or default_model()

    def encode(rows):
        own = codec(model)
        for piece in batches(rows, ["doc_id", "text"], 1_000_000):
            ids = [own.encode(t) for t in piece["text"]]
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            decoded = pa.array([own.library.decode(one.tolist()) if len(one) else "" for one in ids], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(piece["doc_id"], pa.int64()), lists, decoded], names=["doc_id", "ids", "decoded"])

    return id_text(docs).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
