"""SentencePiece BPE encoding by a table of last tokens, and decoding.

A sequence of tokens is the encoding of its text if and only if every two neighbours are the encoding of
theirs (they are compatible). So each prefix of a text has one last token: among the pieces that end there,
which an Aho-Corasick automaton names, the one compatible with the last token of the prefix before it. The
ids of the whole text are then read backwards from its end. No merge crosses a place where no piece holds
the two characters around it, so the table is made word by word and kept for words that return.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from siftwell.llm.common import map_rows, whole_text

MARK = "▁"  # what the model has for a space
KEPT_WORDS = 200_000  # memory of a worker; words beyond it are encoded again when they return
KEPT_PAIRS = 500_000


class Pieces:
    """The table encoder of one model of type BPE with the identity normaliser."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model that keeps the text as it is is needed")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        size = self.library.get_piece_size()
        self.bytes = {int(self.library.id_to_piece(i)[1:-1], 16): i for i in range(size) if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        special = {i for i in range(size) if self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)}
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if i not in special}
        self.rank = {piece: -self.library.get_score(i) for piece, i in self.ids.items()}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.ids):
            raise ValueError("a piece of the model reaches over a word's begin")
        self.text = {i: piece for piece, i in self.ids.items()}
        reached = {piece: i for piece, i in self.ids.items() if self.merged(piece) == [piece]}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in reached.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.size = [len(self.text.get(i, "")) for i in range(size)]
        self.fits: list[dict[int | None, bool]] = [{} for _ in range(size)]
        self.pairs = 0
        # a word of letters and digits ends where another character follows, but for those few that share a piece with it
        crossed = "".join(sorted({a for piece in reached for a in re.findall(rf"([^\W_])(?=[^\w{MARK}]|_)", piece)}))
        own = "".join(c for c in "\n\r\t" if c not in self.ids)  # unknown characters, which merge with nothing
        first = rf"{MARK}*[^\W_{crossed}]++" + f"(?![{crossed}])" * bool(crossed)
        self.words = re.compile(f"{first}|{MARK}*[^{MARK}{own}]+|{MARK}+" + f"|[{own}]" * bool(own))
        self.known = Known(self)

    def merged(self, text: str) -> list[str]:
        """The merges done one by one: best rank first, leftmost on ties. For texts of one or two pieces."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        return self.merged(a + b) == [a, b]

    def word(self, word: str) -> tuple[int, ...]:
        last: list[int | None] = [None] * len(word)
        done, size, fits = -1, self.size, self.fits
        for end, token in self.automaton.iter(word):  # at each place the longest piece first
            if end == done:
                continue
            start = end - size[token]
            if start >= 0:
                before = last[start]
                fit = fits[token].get(before)
                if fit is None:  # a place without a token is an unknown character, which merges with nothing
                    fit = fits[token][before] = before is None or self.compatible(before, token)
                    self.pairs += 1
                if not fit:
                    continue
            last[end], done = token, end
        if self.pairs > KEPT_PAIRS:
            self.fits = [{} for _ in fits]
            self.pairs = 0
        ids, at = [], len(word) - 1
        while at >= 0:
            token = last[at]
            if token is None:
                if self.bytes:
                    ids += [self.bytes[b] for b in reversed(word[at].encode())]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
                at -= 1
            else:
                ids.append(token)
                at -= size[token]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """The ids, the same as the library's encode(text). An empty text has none."""
        if not text:
            return []
        words = self.words.findall(self.prefix + text.replace(" ", MARK))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


class Known(dict):
    """Words encoded before, up to a bound: when half of it is full, those not used since the last time give way."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.pieces.word(word)
        if len(self) >= KEPT_WORDS // 2:
            self.older = dict(self)
            super().clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.older = {}


_loaded: dict[str, Pieces] = {}


def loaded(model: str) -> Pieces:
    """The model of a worker process, read once."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns, and `ids` (array of int); with `decoded` also the text the library decodes them to.

    Null and empty texts have no ids and decode to an empty text. A given column of the same name as a new
    one is replaced. Rows are independent: repeated rows give equal results, an empty table gives none. `model` is a path that every
    executor has.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    given = docs.select(*keep, whole_text(text).alias("__whole"))
    schema = given.drop("__whole").schema.add(ids, ArrayType(IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in rows:
            for part in parts(batch):
                encoded = [pieces.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                arrays = [*part.columns[:-1], pa.array(encoded, pa.list_(pa.int32()))]
                names = [*part.schema.names[:-1], ids]
                if decoded:
                    arrays.append(pa.array([pieces.decode(x) if x else "" for x in encoded], pa.string()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(arrays, names)
        pieces.known.clear()  # the worker lives on for other stages

    return map_rows(given, run, schema)


def parts(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `limit` bytes of its last column, so that the ids of few texts are held at once."""
    sizes = [len(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)
