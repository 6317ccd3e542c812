"""Merge-type SentencePiece encoding by a table of each prefix's last token.

Under merge rules a text's encoding, cut after any token, is the encoding of that prefix. So each
prefix has one last token: the token that ends there and is compatible with the last token of the
prefix before it. An automaton lists the tokens that end at each place, a memoised test says
whether two tokens stay apart when their joint text is merged, and the ids are read backwards.

Characters outside the vocabulary join no merge and become bytes. A text is cut where no piece
can reach across: before a space mark after another character, around control characters that no
longer piece holds, and after a Latin letter or digit before anything else, if the model's pieces
allow it, which is verified on loading. Each part is encoded on its own, and parts are remembered.

Null and empty texts give the begin and end ids only; a very long text is one task's work; an empty
table gives an empty one. Repeated rows and ties need no care: rows are independent. Columns with other names are kept; ``ids`` and ``decoded`` replace columns of
these names.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches, schema_with, texts

SPACE = "▁"
_LATIN = "A-Za-z0-9À-ÖØ-öø-ɏ"
#: Units longer than this aren't remembered; so many are at most, and so many pairs of tokens.
LONGEST_KEPT, MOST_KEPT, MOST_PAIRS = 48, 300_000, 500_000


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        shown = [p.replace(SPACE, " ").encode() if plain[i] else b"" for i, p in enumerate(self.pieces)]
        shown[self.unk] = " ⁇ ".encode()
        for b, i in self.byte_id.items():
            shown[i] = bytes([b])
        self.size = np.array([len(b) for b in shown], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.buffer = np.frombuffer(b"".join(shown), np.uint8)
        self.spaced = [plain[i] and p.startswith(SPACE) for i, p in enumerate(self.pieces)]
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self._merged(p) == [p]:
                self.automaton.add_word(p, (self.ids[p], len(p)))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.cut = self._cuts()
        self.apart: dict[int, bool] = {}
        self.units = _Units(self._unit)

    def _cuts(self) -> re.Pattern[str]:
        joined = [p for p in self.ids if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in joined):
            return re.compile("(?s).+")
        if any(re.search(f"[{_LATIN}][^{_LATIN}]", p) for p in joined):
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        held = set("".join(joined))
        alone = "".join(re.escape(chr(i)) for i in range(32) if chr(i) not in held)
        other = f"[^{_LATIN}{SPACE}{alone}]"
        return re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}*{other}*[{_LATIN}]+|{SPACE}*{other}+|{SPACE}+")

    def _merged(self, text: str) -> list[str]:
        """Merge by score, leftmost first; for short texts only."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, key: int) -> bool:
        if len(self.apart) >= MOST_PAIRS:
            self.apart.clear()
        left, right = self.pieces[key >> 32], self.pieces[key & 0xFFFFFFFF]
        known = self.apart[key] = self._merged(left + right) == [left, right]
        return known

    def _unit(self, unit: str) -> list[int]:
        """A place that no token ends at is the end of a character outside the vocabulary, which
        joins nothing: any token may follow it."""
        last, apart = [-1] * (len(unit) + 1), self.apart
        for end, (piece, length) in self.automaton.iter(unit):
            if last[end + 1] < 0:
                start = end + 1 - length
                before = last[start]
                if before >= 0:
                    key = before << 32 | piece
                    fits = apart.get(key)
                    if not (self._compatible(key) if fits is None else fits):
                        continue
                last[end + 1] = piece
        out, at = [], len(unit)
        while at:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
                at -= self.length[piece]
            else:
                at -= 1
                out.extend([self.byte_id[b] for b in reversed(unit[at].encode())] if self.byte_id else [self.unk])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        middle = b""
        if text:
            middle = b"".join(map(self.units.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))
        return self.bos.to_bytes(4, "little") + middle + self.eos.to_bytes(4, "little")

    def decode(self, packed: bytes) -> str:
        """Text of packed ids: control ids are silent, the first piece loses the space that encoding
        put before it, and byte ids join to characters. All pieces lie in one buffer, from which
        the text's bytes are gathered at once."""
        ids = np.frombuffer(packed, "<u4")
        if len(ids) and (ids[0] == self.bos or ids[-1] == self.eos):
            ids = ids[(ids != self.bos) & (ids != self.eos)]
        if not len(ids):
            return ""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        out = self.buffer[np.repeat(self.start[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        return (out[1:] if self.spaced[ids[0]] else out).decode("utf-8", "replace")


class _Units(dict):
    """Packed ids by part of a text, filled as parts come, emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        packed = array("I", self.encode(unit)).tobytes()
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[unit] = packed
        return packed


@cache
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    """A model file, if it's of the kind that this encoder is exact for."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    trained, normal = proto.trainer_spec, proto.normalizer_spec
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and normal.escape_whitespaces
    if trained.model_type != trained.BPE or not plain or trained.treat_whitespace_as_suffix or any(p.type == p.USER_DEFINED for p in proto.pieces):
        raise ValueError(f"{path}: only merge-type models without normaliser, with a dummy prefix, all white space and no pieces of users are known")
    return model


def encode_column(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    The model file is read on the driver and travels with the task, so executors need no copy.
    """
    model = read_model(model_path)
    df = df.drop("ids", "decoded")
    schema = schema_with(df, "ids binary, decoded string")

    def make():
        c = codec(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [c.encode(t) for t in texts(batch, text)]
            decoded = [c.decode(p) for p in packed]
            columns = [*batch.columns, pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "ids", "decoded"])

        return work

    return map_batches(df, make, schema)


def digests(encoded: DataFrame) -> list:
    return [
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]
