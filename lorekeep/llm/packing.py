"""Pack tokenised documents into sequences of bounded length.

Documents are cut only if they are longer than a sequence. The pieces are dealt into
groups of bounded size; in each, bin completion fills the sequences, and what is left
in loosely filled ones is packed again together with that of other groups.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import kept_in_worker, slices

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Tokens, and pieces, that one task packs at a time.
GROUP_TOKENS = 4_000_000
GROUP_ROWS = 100_000
#: Branches that the search may try in a group before it keeps its incumbent.
NODES = 20_000
#: Words whose ids a worker remembers, until a task of another operator runs in it.
CACHE_WORDS = 1_000_000
#: Fillings that a branch keeps, and steps that the search for them may take.
FILLINGS = 6
FILLING_STEPS = 400
#: Memory of a group's search for the fillings it has found.
KNOWN_BYTES = 32 << 20
#: Masks of the bits 0 to x, as far as they were needed.
_UP_TO: list[int] = []

#: Letters, then perhaps punctuation but no apostrophe: these are split just between the two.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_LETTERS = "".join(c for c in map(chr, range(256)) if _PLAIN.fullmatch(c))
#: White space, which no token spans; other characters that Python counts as such stay in their word.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f"]
#: What a character is, by its byte or two bytes in UTF-8: white space, a letter, punctuation that may follow letters, or other.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KINDS, _PAIRS = np.full(256, _OTHER, np.uint8), np.full(1 << 16, _OTHER, np.uint8)
for _kind, _signs in (
    (_SPACE, _SPACES), (_LETTER, _LETTERS), (_MARK, [c for c in map(chr, range(128)) if (m := _PLAIN.fullmatch(f"a{c}")) and m[2]]),
):
    for _raw in (c.encode() for c in _signs):
        if len(_raw) < 3:
            (_KINDS, _PAIRS)[len(_raw) - 1][int.from_bytes(_raw)] = _kind
#: White space of three bytes.
_WIDE = np.array([int.from_bytes(c.encode()) for c in _SPACES if len(c.encode()) == 3])
#: From here on, a byte is the first one of several.
_LEAD = 0xC2
#: The last byte of the capitals among the plain letters; small letters are 32 above.
_CAPITAL = np.zeros(256, bool)
_CAPITAL[[c.encode()[-1] for c in _LETTERS if c.lower() != c]] = True
_loaded: dict[str, tuple] = {}
kept_in_worker.append(_loaded)


def _tokenizer(name: str):
    """The tokenizer, the one for folded plain words, which tokens end a word, and the words already seen; a worker
    keeps them for its next task.

    Where normalising does no more to plain letters than lower-case them, a word is folded before, and goes
    through a tokenizer without that step, which also splits at white space only if that gives the same
    words; else the second is the tokenizer itself.
    """
    if name not in _loaded:
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[no for token, no in vocabulary.items() if token.endswith("</w>")]] = True
        tokenizer.model._resize_cache(0)  # each word is encoded once
        folded, lower = tokenizer, _LETTERS.lower()
        normalizer = tokenizer.normalizer
        if normalizer and {normalizer.normalize_str(f" {x} ") for x in (_LETTERS, lower)} == {f" {lower} "}:
            folded = Tokenizer.from_file(public_tokenizers.path(name))
            folded.normalizer = None
            folded.model._resize_cache(0)
            plainer, words = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]), " ".join([lower, *lower])
            if folded.pre_tokenizer and folded.pre_tokenizer.pre_tokenize_str(words) == plainer.pre_tokenize_str(words):
                folded.pre_tokenizer = plainer
        _loaded[name] = tokenizer, folded, ends, {}
    return _loaded[name]


def _encode_each(tokenizer, parts: list[str]) -> list[bytes]:
    encoded = tokenizer.encode_batch_fast(parts, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in encoded]


def _learn_words(tokenizer, folded, ends: np.ndarray, words: Iterable[str], known: dict[str, bytes]) -> None:
    """Put the ids of each word, as ``_split_words`` gives them, in ``known``.

    Words of plain letters go through the tokenizer together and are cut where a token ends a word.
    """
    plain, rest = [], []
    for w in words:
        m = _PLAIN.fullmatch(w)
        (plain if m and not m[2] else rest).append(w)
    known.update(zip(rest, _encode_each(tokenizer, rest)))
    for start in range(0, len(plain), 2_000):
        part = plain[start:start + 2_000]
        ids = np.array(folded.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) == len(part):
            raw = ids.tobytes()
            known.update(zip(part, [raw[x:y] for x, y in zip([0, *cuts], cuts)]))
        else:
            known.update(zip(part, _encode_each(tokenizer, part)))


def _split_words(texts: pa.Array, fold: bool) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and where each text's begin (and the last one's end).

    Words stand between white space. Plain ones are cut before their punctuation, and lower-cased if ``fold``.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:-1] >= _LEAD)
    pair = data[lead].astype(np.int64) << 8 | data[lead + 1]
    for what in (_SPACE, _LETTER):
        own = lead[_PAIRS[pair] == what]
        kind[own] = kind[own + 1] = what
    wide = np.flatnonzero(np.isin(pair, _WIDE >> 8))
    own = lead[wide][np.isin(pair[wide] << 8 | data[lead[wide] + 2], _WIDE)]
    kind[own] = kind[own + 1] = kind[own + 2] = _SPACE
    inside = kind != _SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[at < len(data)]
    first[begins] = inside[begins]
    text_word = np.searchsorted(np.flatnonzero(first), at)

    # From here on without the white space.
    data, kind, first = data[inside], kind[inside], first[inside]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(len(at), np.int64)
    letter = kind == _LETTER
    after = np.zeros(len(data), bool)  # a letter of the same word stands before
    after[1:] = letter[:-1] & ~first[1:]
    odd = (kind == _OTHER) | (letter & ~after & ~first) | (~letter & first)
    plain = ~np.logical_or.reduceat(odd, starts)

    def in_plain(places: np.ndarray) -> np.ndarray:
        return places[plain[np.searchsorted(starts, places, "right") - 1]]

    if fold:
        data[in_plain(np.flatnonzero(letter & _CAPITAL[data]))] += 32
    first[in_plain(np.flatnonzero(~letter & after))] = True
    edges = np.append(np.flatnonzero(first), len(data))
    words = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))
    return words, np.searchsorted(edges, np.append(starts, len(data))[text_word])


def encode_column(texts: pa.Array, name: str = TOKENIZER) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without an end.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its words.
    Each different word is looked up once, and encoded once in a worker as long as it remembers the ids.
    """
    tokenizer, folded, ends, known = _tokenizer(name)
    words, at = _split_words(texts, folded is not tokenizer)
    coded = words.dictionary_encode()
    different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = list(map(known.get, different))
    new = [w for w, x in zip(different, found) if x is None]
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()  # what these texts need of it is in ``found``
    _learn_words(tokenizer, folded, ends, new, known)
    ids = pa.array([known[w] if x is None else x for w, x in zip(different, found)], pa.large_binary()).take(coded.indices)
    cuts = (np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[at] if len(ids) else at).tolist()
    raw = memoryview(ids.buffers()[2] or b"")
    return [bytes(raw[x:y]) for x, y in zip(cuts, cuts[1:])]


def encode_texts(texts: list[str | None], name: str = TOKENIZER) -> list[bytes]:
    return encode_column(pa.array(texts, pa.large_string()), name)


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's text; the end id is part of it."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                      ("ids_crc32", pa.int64())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", own=_loaded):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_column(batch.column("text"), name)):
                ids += end
                for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, no, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing on lengths: the incumbent of the search."""
    open_at: dict[int, list[list[int]]] = defaultdict(list)
    free, bins = 0, []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = free >> length
            if fits:
                room = (fits & -fits).bit_length() - 1 + length
                own = open_at[room].pop()
                if not open_at[room]:
                    free &= ~(1 << room)
            else:
                room, own = capacity, []
                bins.append(own)
            own.append(length)
            room -= length
            if room:
                open_at[room].append(own)
                free |= 1 << room
    return bins


def fillings(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
    return fillings_of(sum(1 << x for x in lengths if counts[x]), counts, room)


def fillings_of(mask: int, counts: dict[int, int], room: int, most: int = FILLINGS, steps: int = FILLING_STEPS) -> list[tuple[int, ...]]:
    """Undominated sets of lengths (descending) that fill ``room`` best, the tightest first.

    One length equal to the room dominates every other filling. A set is dominated if a
    single length of at least its sum still fits, or if another length could be added.
    Bit x of ``mask`` is set if ``counts[x]`` is not 0. The ``most`` tightest of those that
    ``steps`` steps find are kept: the search is bounded, not exhaustive.
    """
    if counts.get(room):
        return [(room,)]
    for x in range(len(_UP_TO), room + 1):
        _UP_TO.append((2 << x) - 1)
    # (mask & _UP_TO[x]).bit_length() - 1 is the largest length of at most x that is left; below 1 if none is.
    largest = (mask & _UP_TO[room]).bit_length() - 1 if room > 0 else 0
    if largest < 1:
        return [()]
    mask &= _UP_TO[largest]
    least = (mask & -mask).bit_length() - 1
    found: dict[tuple[int, ...], int] = {(largest,): largest} if largest + least > room else {}
    best, tried = 0, 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(largest, room, ())]
    while stack and tried < steps:
        x, left, own = stack.pop()
        tried += 1
        if left < x:
            x = left
        x = (mask & _UP_TO[x]).bit_length() - 1 if x >= least else 0
        while x and own.count(x) >= counts[x]:
            x = (mask & _UP_TO[x - 1]).bit_length() - 1 if x > least else 0
        if not x:
            total = room - left
            if own and (len(own) == 1 or total > largest):
                found[own] = total
                best = max(best, total)
                if best == room:
                    break
            continue
        stack.append((x - 1, left, own))
        stack.append((x, left - x, own + (x,)))
    if not found:
        own, left, x = [], room, largest
        while x:
            while x <= left and own.count(x) < counts[x]:
                own.append(x)
                left -= x
            below = min(x - 1, left)
            x = (mask & _UP_TO[below]).bit_length() - 1 if below >= least else 0
        found[tuple(own)] = room - left
    return sorted(found, key=lambda s: (-found[s], len(s), tuple(-x for x in s)))[:most]


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bin completion: branch on the fillings around the largest length left.

    A branch ends when the waste so far already forces as many bins as the incumbent
    has. If no branch beats it within ``nodes`` tries, the incumbent stays.
    """
    incumbent = best_fit(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    large = sum(n for x, n in counts.items() if 2 * x > capacity)
    bound = max(-(-total // capacity), large)
    full_mask = sum(1 << x for x, n in counts.items() if n)
    # What is left as one number, a field of bits per length: many branches come to the same lengths, and its fillings are kept.
    width = max(counts.values(), default=0).bit_length()
    unit = {x: 1 << (width * i) for i, x in enumerate(sorted(counts))}
    known: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    most_known = KNOWN_BYTES // (1_000 + width * len(counts) // 8)
    full_state = sum(unit[x] * n for x, n in counts.items())
    tried = 0
    while len(incumbent) > bound and tried < nodes:
        allowed = (len(incumbent) - 1) * capacity - total
        left, mask, state, waste, path, better = dict(counts), full_mask, full_state, 0, [], None
        pieces = sum(counts.values())
        # A frame: the bin's largest length, its fillings, the next one to try, the one in place.
        frames: list[list] = []

        def take(x: int) -> None:
            nonlocal mask, state, pieces
            left[x] -= 1
            state -= unit[x]
            pieces -= 1
            if not left[x]:
                mask ^= 1 << x

        def give(x: int) -> None:
            nonlocal mask, state, pieces
            if not left[x]:
                mask ^= 1 << x
            left[x] += 1
            state += unit[x]
            pieces += 1

        def descend() -> bool:
            if not mask:
                return False
            first = mask.bit_length() - 1
            take(first)
            fills = known.get((state, first))
            if fills is None:
                fills = fillings_of(mask, left, capacity - first)
                if len(known) < most_known:
                    known[state, first] = fills
            frames.append([first, fills, 0, None])
            return True

        open_ = descend()
        while open_ and tried < nodes:
            frame = frames[-1]
            if frame[3] is not None:
                for x in frame[3]:
                    give(x)
                waste -= capacity - frame[0] - sum(frame[3])
                frame[3] = None
                path.pop()
            if frame[2] == len(frame[1]):
                give(frame[0])
                frames.pop()
                open_ = bool(frames)
                continue
            fill = frame[1][frame[2]]
            frame[2] += 1
            tried += 1
            lost = capacity - frame[0] - sum(fill)
            if waste + lost > allowed and pieces > len(fill):
                frame[2] = len(frame[1])  # the other fillings waste more
                continue
            for x in fill:
                take(x)
            frame[3] = fill
            waste += lost
            path.append([frame[0], *fill])
            if not descend():
                if len(path) < len(incumbent):
                    better = [list(b) for b in path]
                    break
        if better is None:
            break
        incumbent = better
    return incumbent


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to settled ``pieces``, which have a ``length`` up to ``capacity``.

    Whole pieces are sequences of their own. The rest is dealt by hash into groups of
    about ``group_tokens`` tokens. Sequences of a group that are filled to 31/32 are
    final; the other ones' pieces are packed again with those of other groups, until
    one group is left, or what is loose no longer halves (lengths that cannot fill).
    """
    columns = pieces.columns
    full = pieces.where(F.col("length") >= capacity).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left = pieces.where(F.col("length") < capacity).withColumn("_row", F.monotonically_increasing_id())
    done, level, before = [full], 0, None
    while True:
        held = left.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
        groups = max(1, -(-held["tokens"] // group_tokens), -(-held["rows"] // GROUP_ROWS))
        last = groups == 1 or (before is not None and 2 * held["tokens"] > before)
        before = held["tokens"]
        dealt = left.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
        # A number of partitions that is asked for is not joined again: a task has about a group.
        packed = settle(_pack_groups(dealt.repartition(groups, "_group"), capacity, level, last), f"packed-{level}")
        done.append(packed.where("not _loose").select(*columns, "sequence_id", "offset"))
        if last:
            break
        left, level = packed.where("_loose").select(*columns, "_row"), level + 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def _pack_groups(dealt: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    names = [c for c in dealt.columns if c != "_group"]
    schema = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in names)
    loose_below = capacity - capacity // 32

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        at: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(table.column("length").to_pylist()):
            at[n].append(i)
        rows = table.num_rows
        sequence, offset, loose = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, bool)
        base = (level << 58) + (table.column("_group")[0].as_py() << 22)
        for no, own in enumerate(complete_bins({n: len(rows) for n, rows in at.items()}, capacity)):
            used, fill = 0, sum(own)
            for n in own:
                i = at[n].pop()
                sequence[i], offset[i], loose[i] = base + no, used, not last and fill < loose_below
                used += n
        out = table.select(names)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_loose", loose)):
            out = out.append_column(name, pa.array(values))
        return out

    return dealt.groupBy("_group").applyInArrow(pack, f"{schema}, sequence_id long, offset long, _loose boolean")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """Where each piece of each document lies: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece that holds the end id. Rows with the same doc_id
    are documents of their own. Only lengths and checksums are shuffled, never ids.
    An empty table gives no rows; other columns are not looked at.
    """
    pieces = settle(tokenised_pieces(docs, capacity, name), "pieces")
    return pack_pieces(pieces, capacity)


def sequences(docs: DataFrame, placed: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), for documents with distinct ids."""
    end = np.array([END_ID], "<u4")

    @F.pandas_udf("array<long>")
    def ids_of(texts: pd.Series) -> pd.Series:
        got = encode_texts(list(texts), name)
        return pd.Series([np.concatenate([np.frombuffer(b, "<u4"), end]).astype(np.int64) for b in got])

    parts = placed.join(docs.select("doc_id", "text"), "doc_id").withColumn("_ids", ids_of("text")).withColumn(
        "_part", F.expr("slice(_ids, cast(start + 1 as int), cast(length as int))"))
    return parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "_part"))).alias("_parts")).select(
        "sequence_id", F.flatten(F.col("_parts._part")).alias("ids"))
