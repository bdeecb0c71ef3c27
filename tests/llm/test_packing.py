import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import packing
from lorekeep.llm.packing import (
    TOKENIZER, best_fit, complete_bins, encode_column, encode_texts, fillings, pack_documents, pack_pieces, sequences, tokenised_pieces,
)

from .data import documents, frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_word_by_word_ids_are_the_tokenizers(tokenizer):
    texts = [t or "" for _, t, *_ in documents()] + [
        "don't I'll stop,it's \x1c \x85 a b <|endoftext|>x İstanbul 12,5% ...!!! 'tis we've", "THE!! x''s ẞ é a ́b"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode_texts(texts) == want


def test_placements(spark, tokenizer):
    rows = documents()
    got = pack_documents(frame(spark)).collect()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    for doc, own in ids.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and len(parts) == -(-len(own) // 4096)
        assert all(p.length == 4096 for p in parts[:-1]) and sum(p.length for p in parts) == len(own)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-total // 4096) + 1
    whole = {r.sequence_id: r.ids for r in sequences(frame(spark), pack_documents(frame(spark))).collect()}
    assert sum(map(len, whole.values())) == total


def least_bins(lengths, capacity):
    """By trying all ways."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_best_on_small_sets():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted((rng.randrange(15, 70) for _ in range(9)), reverse=True)
        got = complete_bins(Counter(lengths), 100)
        assert sorted(itertools.chain(*got), reverse=True) == lengths and all(sum(b) <= 100 for b in got)
        assert len(got) == least_bins(lengths, 100) <= len(best_fit(Counter(lengths), 100))


def test_search_has_the_nodes_for_lengths_that_best_fit_packs_badly():
    lengths = [
        49, 45, 45, 44, 44, 44, 42, 42, 42, 40, 39, 39, 38, 37, 37, 37, 37, 36, 34, 34,
        34, 34, 34, 31, 30, 30, 30, 30, 30, 29, 28, 27, 27, 27, 26, 26, 26, 26, 25, 24,
    ]
    got = complete_bins(Counter(lengths), 100)
    assert sorted(itertools.chain(*got), reverse=True) == lengths and all(sum(b) <= 100 for b in got)
    assert len(got) == 14


def test_fillings_are_tight_and_use_what_there_is():
    counts = Counter([50, 30, 30, 20, 7])
    assert fillings(sorted(counts, reverse=True), counts, 50) == [(50,)]
    own = fillings(sorted(counts, reverse=True), counts, 67)
    assert sum(own[0]) == 67 and all(not Counter(f) - counts for f in own)
    assert fillings([9], Counter({9: 1}), 5) == [()]


def test_levels_of_groups(spark):
    rng = random.Random(4)
    lengths = [(i, 0, 0, rng.randrange(1, 4097), 0) for i in range(2000)]
    df = spark.createDataFrame(lengths, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack_pieces(df, group_tokens=300_000).collect()
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 2000 and max(fill.values()) <= 4096
    # Groups of some 150 pieces, most of them large: all pieces together take 998.
    assert len(fill) <= 1.04 * 998


def test_repeated_rows_and_no_rows(spark):
    rows = [(5, "a b c", "", "", 0)] * 3 + [(None, None, "", "", 0)]
    got = pack_documents(frame(spark, rows)).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert pack_documents(frame(spark, [])).count() == 0
    assert tokenised_pieces(frame(spark, [])).count() == 0


def test_letter_cases_are_encoded_once(tokenizer, monkeypatch):
    texts = ["Éreairé hasted", "éreairé, HASTED", "ÉREAIRÉ. Hasted hAsted!?", "ÀÖØÞß àöøþß ÿ µ ª º İ ı Σς", "it's IT'S Don't l'Été"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    packing._loaded.clear()
    seen = packing._tokenizer(TOKENIZER)
    tokens = []

    class Counting:
        def encode_batch_fast(self, parts, **kwargs):
            tokens.extend(w for p in parts for w in p.split())
            return seen[1].encode_batch_fast(parts, **kwargs)

    assert seen[1] is not seen[0]
    monkeypatch.setitem(packing._loaded, TOKENIZER, (seen[0], Counting(), *seen[2:]))
    assert encode_texts(texts) == want
    assert tokens.count("hasted") == tokens.count("éreairé") == 1 and len(tokens) == len(set(tokens))


def test_words_forgotten_between_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    packing._loaded.clear()
    for texts in (["a b c d"], ["a b e F, g", None, ""], ["F, g a\x1fb x y z w"]):
        want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encode_texts(texts) == want


def test_fillings_of_a_state_are_searched_once(monkeypatch):
    rng = random.Random(8)
    lengths = [rng.choice([1001, 1111, 1237, 1303, 1409, 1511, 2003]) for _ in range(60)]
    counts, asked, search = Counter(lengths), Counter(), packing.fillings_of

    def counting(mask, left, room, *bounds):
        asked[room, tuple(sorted((x, n) for x, n in left.items() if n))] += 1
        return search(mask, left, room, *bounds)

    monkeypatch.setattr(packing, "fillings_of", counting)
    kept = complete_bins(dict(counts), 4096, 2_000)
    assert len(asked) > 20 and set(asked.values()) == {1}
    monkeypatch.setattr(packing, "KNOWN_BYTES", 0)
    asked.clear()
    assert complete_bins(dict(counts), 4096, 2_000) == kept
    assert max(asked.values()) > 1


def test_a_repeated_word_is_looked_up_once(monkeypatch):
    packing._loaded.clear()
    looked = Counter()

    class Seen(dict):
        def get(self, word, *rest):
            looked[word] += 1
            return super().get(word, *rest)

    seen = Seen()
    monkeypatch.setitem(packing._loaded, TOKENIZER, (*packing._tokenizer(TOKENIZER)[:3], seen))
    encode_texts(["Hasted, hasted hasted 4x", None, "HASTED! 4x Éreairé,", "éreairé 4X"])
    assert looked and set(looked.values()) == {1}
    # Only folded words and what stands after them are remembered, not each way to write them.
    assert set(seen) == {"hasted", ",", "!", "éreairé", "4x", "4X"}


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_columns_of_any_characters(tokenizer, kind):
    rng = random.Random(6)
    signs = [
        *"aZbTxéÉßÿÀÞ×÷'!,&(", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\u2003", "\u202f", "\u200b", "、", "\u0301", "\u0307", "İ", "ı", "ſ",
        "Σ", "中", "😀", "7", "\x00", "µ", "ª", "'s", "'RE", "<|endoftext|>", "<|ENDOFTEXT|>", "the ", "Thing ", "ing, ",
    ]
    texts = [None, "", " ", "É", "\u00c2\u0300", "a"] + ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(1500)] + ["", None, "é"]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    packing._loaded.clear()
    column = pa.array(texts, kind)
    assert encode_column(column) == want
    assert encode_column(column.slice(3, 700)) == want[3:703]
    assert encode_column(column.slice(1, 2)) == want[1:3] and encode_column(column.slice(0, 0)) == []
    # Texts are kept apart where no white space stands between them, and short ones give the same in one.
    assert encode_texts(["ab", "Cd", ",e"]) == [encode_texts([t])[0] for t in ("ab", "Cd", ",e")]
    assert encode_texts([" ".join(t or "" for t in texts)]) == [b"".join(want)]


def test_words_between_white_space_of_any_kind():
    packing._loaded.clear()
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f"]
    encode_texts([None, *(f"no{c}break{c}{c}no" for c in spaces), "\u3000", "no\x1cbreak"])
    assert set(packing._loaded[TOKENIZER][3]) == {"no", "break", "no\x1cbreak"}
