import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import pieces
from tests.llm.plain import SCHEMA, awkward

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TRICKY = ["", " ", "   ", " a  b ", "\n", "a\n\n b\t", "▁", "▁▁a▁ ▁b", "<s></s><unk><0x41>", "ﬁ①　é\x00", "🦙 🦙🦙", "5 m² a².b", "_a_b.c,d don't (x) 3.14",
          "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the" * 50, "    indent\n        deep", "é́", "$x_{1}\\,$", "a" * 5000, "http://www.example.com/?q=1&r=%20"]


@pytest.mark.parametrize("text", TRICKY)
def test_same_as_the_library(library, text):
    assert pieces.loaded(MODEL).encode(text) == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" abcdehilnorstu.,'\n▁²_", max_size=60)))
def test_same_as_the_library_on_any_text(text):
    own = pieces.loaded(MODEL)
    assert own.encode(text) == own.library.encode(text)


def test_frames(spark, library):
    rows = [(*r, [1]) for r in awkward()]
    out = pieces.encode(spark.createDataFrame(rows, SCHEMA + ", ids array<int>"), MODEL, decoded="decoded").collect()
    assert len(out) == len(rows)
    for given_row, row in zip(sorted(rows, key=str), sorted(out, key=lambda r: str((r["doc_id"], r["text"], r["n"], r["digest"], [1]))), strict=True):
        ids = library.encode(given_row[1] or "")
        assert row["ids"] == ids and row["decoded"] == library.decode(ids)
    assert pieces.encode(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_bounded_memory_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 5)
    own = pieces.Pieces(MODEL)
    for text in TRICKY:
        assert own.encode(text) == library.encode(text)
    assert len(own.known) <= 3


def test_frequent_words_are_kept(monkeypatch):
    """A word that returns among many others is encoded once; before, a full memory was emptied with it."""
    monkeypatch.setattr(pieces, "KEPT_WORDS", 40)
    own = pieces.Pieces(MODEL)
    encoded, word = [], own.word
    monkeypatch.setattr(own, "word", lambda text: encoded.append(text) or word(text))
    for i in range(300):
        assert own.encode(f"often rare{'x' * i}") == own.library.encode(f"often rare{'x' * i}")
        assert len(own.known) + len(own.known.older) <= 40
    assert sum("often" in text for text in encoded) == 1
    own.known.clear()
    assert not own.known and not own.known.older
