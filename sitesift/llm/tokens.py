"""Exact, memoised use of a tokenizers vocabulary inside tasks.

Both vocabularies used here can be split at places where the library itself always splits, so a text's ids
are the ids of its chunks in a row.  Chunks recur, so each worker keeps a bounded memo of them; the library
encodes what the memo does not have.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .words import GAP, LOWER

# Texts whose white space is not all ASCII, and texts holding a special string, go to the library whole.
OTHER_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
# A word with the one space before it, or white space as the byte-level pattern cuts it.
SPACED = re.compile(rb" ?\S+|\s+(?!\S)|\s+")
MEMO_ROWS = 900_000
_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of ``path``, once per worker, without truncation, padding or threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


class Memo(dict):
    """chunk -> value; emptied when it holds ``rows`` chunks, so a worker's memory stays bounded."""

    def __init__(self, rows: int):
        super().__init__()
        self.rows = rows

    def room(self, n: int) -> None:
        if len(self) + n > self.rows:
            self.clear()


def encode_all(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


_memos: dict[tuple, Memo] = {}


def memo(*key, rows: int = MEMO_ROWS) -> Memo:
    if key not in _memos:
        _memos[key] = Memo(rows)
    return _memos[key]


def fill(known: Memo, rows: list[list[bytes]], make) -> dict[bytes, object]:
    """``known`` with every chunk of ``rows``; ``make(chunks)`` gives the values of those it lacks."""
    here = set().union(*rows)
    missing = list(here.difference(known))
    if missing:
        known.room(len(missing))
        if not known:
            missing = list(here)
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            known.update(zip(part, make(part), strict=True))
    return known


def looked_up(known: Memo, parts: list[bytes], make) -> list:
    """The value of each of ``parts`` (all distinct); ``make(parts)`` gives those that ``known`` lacks, which it then holds."""
    out = list(map(known.get, parts))
    lacking = [i for i, x in enumerate(out) if x is None]
    if lacking:
        missing = [parts[i] for i in lacking]
        known.room(len(missing))
        for i, p, x in zip(lacking, missing, make(missing), strict=True):
            out[i] = known[p] = x
    return out


def packed_ids(path: str, chunks: list[bytes]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each chunk."""
    return [array("I", ids).tobytes() for ids in encode_all(path, [c.decode("utf-8", "replace") for c in chunks])]


# What a vocabulary's file states where ``cut_texts`` cuts its pre-tokens.
CUT_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT_SPLIT = [
    {"type": "Split", "pattern": {"Regex": CUT_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
# Kinds of bytes; OTHER ones (control characters, letters beyond Latin-1) leave their word whole.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[GAP] = SPACE
LATIN = np.arange(256, dtype=np.uint8)  # lower case of the byte after 0xC3: all but sharp s
LATIN[0x80:0x9F] += 32
PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*").fullmatch


class Pieces:
    """How a vocabulary with word ends cuts words into pre-tokens, as its file states it.

    ``usable`` tells whether ``cut_texts`` cuts them the same way, ``special`` finds its special strings, ``ends`` which
    ids end a pre-token; ``merges`` is its model alone, for lower-case pre-tokens with spaces between.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, vocab = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        cuts = (parts_of(spec["normalizer"], "normalizers"), parts_of(spec["pre_tokenizer"], "pretokenizers"))
        self.usable = bool(suffix) and cuts == (CUT_NORMALIZER, CUT_SPLIT)
        if self.usable:
            self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in spec["added_tokens"]) or b"(?!)")
            self.ends = np.zeros(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, CUT_SPLIT[1]]}
            bare = {"normalizer": None, "pre_tokenizer": split, "added_tokens": [], "truncation": None, "padding": None}
            self.merges = Tokenizer.from_str(json.dumps(spec | bare))


def parts_of(step: dict | None, name: str) -> list[dict]:
    return [] if step is None else step.get(name, [step])


def cut_texts(texts: list[bytes], special: re.Pattern) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pre-tokens of all texts in a row, lower-cased, and the number of the first of each text.

    Cuts as CUT_PATTERN does.  Words that hold a special string or characters other than printable ASCII and Latin-1
    letters stay whole and as they are.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    kind, low = KIND[raw], LOWER[raw]
    at = np.flatnonzero(raw == 0xC3)
    after = raw[at + 1]
    letter = (after & 0xC0 == 0x80) & (after & 0xDF != 0x97)  # no letters: the signs for times and division
    at, after = at[letter] + 1, after[letter]
    kind[at - 1] = kind[at] = LETTER
    low[at] = LATIN[after]
    other = np.append(np.flatnonzero(kind == OTHER), np.array([m.start() for m in special.finditer(joined)], int))
    if len(other):
        gaps = np.flatnonzero(kind == SPACE)
        word = np.unique(np.searchsorted(gaps, other))
        edge = np.zeros(len(raw), np.int8)
        edge[np.where(word > 0, gaps[word - 1] + 1, 0)] = 1
        edge[gaps[word]] = -1
        whole = np.cumsum(edge, dtype=np.int8).view(bool)
        kind[whole] = OTHER
        low[whole] = raw[whole]
    inside = kind != SPACE
    cut = kind == DIGIT
    cut[0] = True
    cut[1:] |= kind[1:] != kind[:-1]
    cut &= inside
    # an apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it
    at = np.flatnonzero(raw == 39)
    at = at[cut[at] & (kind[at] == SIGN)]
    at = at[kind[at + 1] == LETTER]
    a, b = low[at + 1], low[at + 2]
    one = np.isin(a, list(b"stmd"))
    two = np.isin(a, list(b"rv")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    cut[at[one | two] + 1] = False
    for rest in (at[one] + 2, at[two] + 3):
        cut[rest] = inside[rest]
    data = low[inside]
    starts = np.append(np.flatnonzero(cut[inside]), len(data))
    first = np.searchsorted(np.flatnonzero(cut), np.cumsum([0, *(len(t) + 1 for t in texts)]))
    buffers = [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers), first


_pieces: dict[str, Pieces] = {}
JOINED = 1_000  # pre-tokens that the library encodes in one text
PIECE_ROWS = 900_000
LONG = 4 << 20  # bytes of a text from which it is cut block by block
BLOCKS = re.compile(rb"(?s).{%d}\S*|.+" % LONG).findall  # each but the last ends with a word
MARK = "\x01"


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def joined_ids(path: str, pieces: Pieces, parts: list[bytes]) -> list[bytes]:
    """Packed ids of each pre-token: encoded many at once, with a space between, and cut after each id that ends one."""
    out = []
    for i in range(0, len(parts), JOINED):
        part = parts[i : i + JOINED]
        got = pieces.merges.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
        ids = np.array(got[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(pieces.ends[ids]) + 1)).tolist()
        if len(stops) != len(part):  # not one end each: the library takes them one by one
            out += packed_ids(path, part)
            continue
        data = ids.tobytes()
        out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
    return out


def marked_ids(path: str, pieces: Pieces, chunks: list[str]) -> list[bytes]:
    """Packed ids of each chunk: encoded many at once, with MARK between, which is a pre-token and an id of its own."""
    mark = encode_all(path, [MARK])[0]
    if len(mark) != 1 or not pieces.ends[mark[0]]:
        return packed_ids(path, [c.encode() for c in chunks])
    out = []
    for i in range(0, len(chunks), JOINED):
        part = chunks[i : i + JOINED]
        ids = np.array(encode_all(path, [f" {MARK} ".join(part)])[0], "<u4")
        data, at = ids.tobytes(), (4 * np.flatnonzero(ids == mark[0])).tolist()
        out += [data[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(data)], strict=True)]
    return out


def chunk_ids(path: str, chunks: list[bytes]) -> list[bytes]:
    """Packed ids of each word that is left whole: encoded many at once; those that hold a special string or MARK alone."""
    pieces = pieces_of(path)
    if not pieces.usable:
        return packed_ids(path, chunks)
    alone = [MARK.encode() in c or pieces.special.search(c) is not None for c in chunks]
    others = iter(marked_ids(path, pieces, [c.decode("utf-8", "replace") for c, x in zip(chunks, alone, strict=True) if not x]))
    single = iter(packed_ids(path, [c for c, x in zip(chunks, alone, strict=True) if x]))
    return [next(single if x else others) for x in alone]


def piece_ids(path: str, pieces: Pieces, parts: list[bytes]) -> list[bytes]:
    """Packed ids of each part that ``cut_texts`` gives: a pre-token or a whole word."""
    cut = [PLAIN(p) is not None and pieces.special.search(p) is None for p in parts]
    small = iter(joined_ids(path, pieces, [p for p, x in zip(parts, cut, strict=True) if x]))
    whole = iter(chunk_ids(path, [p for p, x in zip(parts, cut, strict=True) if not x]))
    return [next(small if x else whole) for x in cut]


def cut_ids(path: str, pieces: Pieces, texts: list[bytes]) -> list[bytes]:
    """Packed ids of each text: all cut together; only distinct pre-tokens are looked up and, where not known, encoded."""
    parts, first = cut_texts(texts, pieces.special)
    coded = parts.dictionary_encode()
    packed = looked_up(memo("piece", path, rows=PIECE_ROWS), coded.dictionary.to_pylist(), lambda p: piece_ids(path, pieces, p))
    size = np.array([len(x) // 4 for x in packed], np.int64)
    which = coded.indices.to_numpy()
    n = size[which]
    end = np.cumsum(n)
    place = np.repeat((np.cumsum(size) - size)[which] - (end - n), n)
    place += np.arange(len(place))
    data = np.frombuffer(b"".join(packed), "<u4")[place].tobytes()
    bounds = (4 * np.append(0, end)[first]).tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def word_ids(path: str, texts: list[bytes]) -> list[bytes]:
    """Packed ids of each text, for a vocabulary that drops white space (every ASCII space is a split).

    Long texts are cut block by block, so that memory beside the ids is bounded by the block and its last word.
    """
    pieces = pieces_of(path)
    if not pieces.usable:
        rows = [t.split() for t in texts]
        known = fill(memo("word", path), rows, lambda c: chunk_ids(path, c))
        return [b"".join(map(known.__getitem__, row)) for row in rows]
    if any(len(t) > LONG for t in texts):
        return [b"".join(cut_ids(path, pieces, [x])[0] for x in BLOCKS(t)) for t in texts]
    return cut_ids(path, pieces, texts)


def byte_ids(path: str, texts: list[bytes], special: tuple[bytes, ...]) -> list[bytes]:
    """Packed ids of each text, for a byte-level vocabulary that keeps white space."""
    whole = [bool(OTHER_SPACE.search(t)) or any(s in t for s in special) for t in texts]
    rows = [[] if w else SPACED.findall(t) for t, w in zip(texts, whole, strict=True)]
    known = fill(memo("byte", path), rows, lambda c: packed_ids(path, c))
    out = [b"".join(map(known.__getitem__, row)) for row in rows]
    for i, w in enumerate(whole):
        if w:
            out[i] = packed_ids(path, [texts[i]])[0]
    return out
