"""Token counts by the whole-token shortcut.

Proved once on the driver: which vocabulary strings, given alone, are encoded as the one token they name.
In a text, a pre-token found in that set counts one without any merging; only the other pre-tokens go
through the merges (the library's), and are remembered by worker.  No shuffle: one pass over the text.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, slices, text_only
from .tokens import encode_all, fill, memo

MEMO = 300_000  # chunks and, besides, pre-tokens that a worker remembers
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(path: str) -> set[str]:
    """Vocabulary strings that the library encodes, alone, as exactly their own token."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, to_byte = model["end_of_word_suffix"] or "", byte_chars()
    texts, ids = [], []
    for token, i in model["vocab"].items():
        if not token.endswith(end) or any(c not in to_byte for c in token[: len(token) - len(end)]):
            continue
        try:
            s = bytes(to_byte[c] for c in token[: len(token) - len(end)]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        texts.append(s)
        ids.append(i)
    return {s for s, i, got in zip(texts, ids, encode_all(path, texts), strict=True) if got == [i]}


def count_tokens(docs: DataFrame, path: str, pattern: str, special: tuple[str, ...], limit: int, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each row.

    ``pattern`` is the vocabulary's pre-token pattern on lower-cased text, ``special`` its special strings.
    Null text counts as empty (0 tokens); a null doc_id stays null; repeated rows are counted one by one;
    columns other than doc_id and the text are not read.  Text with letters beyond Latin, or with a special
    string, leaves the shortcut: the library encodes that whole chunk.
    """
    # bounded by the vocabulary (some 30,000 strings)
    proved = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def counts(chunks: list[bytes]) -> list[int]:
        cut, whole, rest, find = [], proved.value, memo("rest", path, rows=MEMO), regex.compile(pattern).findall
        other = [i for i, c in enumerate(chunks) if not latin(c) or any(s in c for s in marks)]
        beyond = set(other)
        for i, c in enumerate(chunks):
            cut.append(() if i in beyond else find(c.decode("utf-8").lower()))
        new = list({p for row in cut for p in row if p not in whole and p not in rest})
        rest.room(len(new))
        if not rest:
            new = list({p for row in cut for p in row if p not in whole})
        rest.update(zip(new, map(len, encode_all(path, new)), strict=True))
        out = [sum(1 if p in whole else rest[p] for p in row) for row in cut]
        for i, ids in zip(other, encode_all(path, [chunks[i].decode("utf-8", "replace") for i in other]), strict=True):
            out[i] = len(ids)
        return out

    marks = [s.encode() for s in special]

    def run(batches):
        for b in slices(batches, "text"):
            texts = as_bytes(b.column("text"))
            rows = [t.split() for t in texts]
            known = fill(memo("count", path, rows=MEMO), rows, counts)
            n = [sum(map(known.__getitem__, row)) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return text_only(docs, text=text).mapInArrow(run, SCHEMA)


def latin(chunk: bytes) -> bool:
    """Whether all letters lie below U+0250, where lower case and letter classes are the same in every Unicode
    version and the normal form changes nothing."""
    if chunk.isascii():
        return True
    s = chunk.decode("utf-8", "replace")
    return max(s) < "ɐ" and unicodedata.is_normalized("NFC", s)
