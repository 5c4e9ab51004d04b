from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxelmetry.llm import token_counts as C

WORDS = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = open(WORDS, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(WORDS)
TEXTS = [
    "", " ", "it's 'sample !'s ''s don't I'LL x'd 'été", " a b\u0085c\vd ", "12 3²½ a1b", "Straße, ÄÖ; (x)-[y]", "a\x00b\x1b",
    "ɐ\n", "end ", "İ", "日本 a", "a\x1cb", "x <|endoftext|>", "ÆȺthe ȾȺ", "last ",
]


def direct(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


class Recorder:
    """The library, with the texts that it was given whole."""

    def __init__(self, library):
        self.library, self.model, self.whole = library, library.model, []

    def encode_batch_fast(self, texts, **named):
        self.whole += texts
        return self.library.encode_batch_fast(texts, **named)


def odd(texts):
    return C.pc.match_substring_regex(pa.array(texts), C.odd_texts(VOCABULARY))


def test_pre_tokens_are_those_of_the_library():
    plain = [t for t, o in zip(TEXTS, odd(TEXTS).to_pylist()) if not o]
    got = [[w for w in words if w] for words in C.pre_tokens(pa.array(plain), odd(plain)).to_pylist()]
    spelled = C.WordCounter(VOCABULARY).spelled
    want = [[p for p, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(LIBRARY.normalizer.normalize_str(t))] for t in plain]
    assert [[w.translate(spelled) for w in words] for words in got] == want and len(plain) == 10


def test_only_odd_texts_go_to_the_library_whole():
    counter = C.WordCounter(VOCABULARY, {"the": 1})
    counter.library = Recorder(counter.library)
    assert counter.counts(TEXTS) == [direct(t) for t in TEXTS]
    assert counter.library.whole == TEXTS[9:14]


@pytest.mark.parametrize("text", ["mÆȺ", "ȺȾ", "aȺȾb", "theȺthe", "é Ⱦs"])
def test_letters_whose_lower_case_is_rarer(text):
    assert C.WordCounter(VOCABULARY).counts([text]) == [direct(text)]


def test_parts_and_full_tables_change_no_count(sample, monkeypatch):
    texts = [r.text or "" for r in sample.collect()]
    want = [direct(t) for t in texts]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    monkeypatch.setattr(C, "BYTES", 10_000)
    monkeypatch.setattr(C, "HELD", 100)
    parts, counter = list(C._parts(batch)), C.WordCounter(VOCABULARY, {"the": 1, "and": 1})
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts and len(parts) > 10
    assert [n for p in parts for n in counter.counts(p.column("text"))] == want


def test_frequent_pre_tokens_are_the_most_frequent(sample):
    seen = Counter()
    for r in sample.collect():
        text = LIBRARY.normalizer.normalize_str(r.text or "")
        seen.update(text[lo:hi] for _, (lo, hi) in LIBRARY.pre_tokenizer.pre_tokenize_str(text))
    # a whole table smaller than what one task reports
    texts = sample.select(C.F.coalesce("text", C.F.lit("")).alias("text")).coalesce(1)
    got = C.frequent_lengths(texts, VOCABULARY, 50)
    want = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:50]
    assert list(got) == [w for w, _ in want] and list(got.values()) == [direct(w) for w, _ in want]


def test_tasks_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id INT, text STRING").repartition(5)
    assert sorted(tuple(r) for r in C.count_tokens(docs, WORDS).collect()) == [(1, 3, 2, False), (2, 0, 0, False)]
    nothing = spark.createDataFrame([], docs.schema).repartition(2)
    assert C.count_tokens(nothing, WORDS).collect() == []
