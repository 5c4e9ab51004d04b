import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import AWKWARD
from voxelmetry.llm import pieces as P
from voxelmetry.llm import token_counts as C

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = Tokenizer.from_file(WORDS)
HARD = [
    "", " ", "  a  b ", "a\nb \n c", "▁▁x▁", "\t\ta\r\n);\r", " 　x", "a\u0000b", "<s></s><unk><0x0A>", "日本 é ﬁ", "\U0001f600" * 3,
    "'s 'S ''s don't I'LL x'd", "12 3²½", "İstanbul ΣΣ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "a\x1cb\x85c\x1fd", "ǅ ŉ ſ Ω",
    "Ä" * 300, "-" * 300, "ͅx", "word" * 5000,
]


def direct(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_pieces_match_the_library_on_rows(awkward, sample, none):
    for df in (awkward, sample):
        got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, len(r.ids)) for r in P.encode_texts(df, PIECES).collect()], key=repr)
        want = [(r[0], *direct(r[1] or "")) for r in df.collect()]
        assert got == sorted([(*w, w[1]) for w in want], key=repr)
    assert P.encode_texts(none, PIECES).count() == 0


def test_counts_match_the_library_on_rows(awkward, sample, none):
    for df in (awkward, sample):
        got = sorted([tuple(r) for r in C.count_tokens(df, WORDS, limit=50).collect()], key=repr)
        want = [(r[0], len((r[1] or "").encode()), len(TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids)) for r in df.collect()]
        assert got == sorted([(*w, w[2] > 50) for w in want], key=repr)
    assert C.count_tokens(none, WORDS).count() == 0


CODER = P.ChunkCoder(open(PIECES, "rb").read())
COUNTER = C.WordCounter(open(WORDS, encoding="utf-8").read(), {"the": 1})


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert CODER.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode(text, add_bos=True, add_eos=True))
    assert COUNTER.counts([text]) == [len(TOKENIZER.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sdltrevm_.,;)}<|>▁éß1"), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert CODER.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode(text, add_bos=True, add_eos=True))
    assert COUNTER.counts([text]) == [len(TOKENIZER.encode(text, add_special_tokens=False).ids)]


def test_a_vocabulary_that_crosses_markers_is_refused(monkeypatch):
    monkeypatch.setattr(P, "MARKER", "e")
    with pytest.raises(ValueError):
        P.ChunkCoder(open(PIECES, "rb").read())
