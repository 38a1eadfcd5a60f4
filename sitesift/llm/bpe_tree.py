"""Byte-level BPE over long text by tree concatenation.

A text is halved until its parts are short.  Parts are encoded on their own; two neighbours are joined by
encoding again a window around the seam, made of the last tokens of the left and the first of the right.
The window grows on each side until its outermost tokens there are the ones the part had: from such a token
on, both encodings see the same text in the same state, so the rest of the part stands as it is.

Very long texts are cut into blocks that Spark encodes in separate tasks; the blocks of a text then meet and
are joined the same way.  All other texts are encoded, joined and decoded in the task that read them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, text_only
from .token_counts import byte_chars
from .tokens import byte_ids, load, packed_ids

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_tables: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id (id order), once per worker."""
    if path not in _tables:
        t, to_byte = load(path), byte_chars()
        vocab = t.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            out[i] = bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        _tables[path] = out
    return _tables[path]


def special_strings(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in load(path).get_added_tokens_decoder().values())


def halves(text: bytes, most: int) -> list[bytes]:
    """Parts of at most ``most`` bytes (plus up to three, as characters stay whole), by halving."""
    if len(text) <= most:
        return [text]
    cut = len(text) // 2
    while cut < len(text) and text[cut] & 0xC0 == 0x80:
        cut += 1
    return [text] if cut in (0, len(text)) else halves(text[:cut], most) + halves(text[cut:], most)


def edge(tokens: list[bytes]) -> bool:
    """Whether these tokens in a row are whole characters."""
    try:
        b"".join(tokens).decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def join(path: str, left: np.ndarray, right: np.ndarray, reach: int = 16, agree: int = 4) -> np.ndarray:
    """The ids of two neighbouring texts as one text."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    table = token_bytes(path)
    a, b = reach, reach
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        tail, head = left[len(left) - a :].tolist(), right[:b].tolist()
        # a side that is not at its text's end must begin or end with a whole character
        if a < len(left) and not edge([table[i] for i in tail]):
            a += 1
            continue
        if b < len(right) and not edge([table[i] for i in head]):
            b += 1
            continue
        window = b"".join(table[i] for i in tail + head)
        ids = np.frombuffer(packed_ids(path, [window])[0], "<u4").tolist()
        fits_left = a == len(left) or ids[:agree] == tail[:agree] and len(tail) > agree
        fits_right = b == len(right) or ids[-agree:] == head[-agree:] and len(head) > agree
        if fits_left and fits_right and len(ids) >= agree * (2 if a < len(left) and b < len(right) else 1):
            return np.concatenate([left[: len(left) - a], np.array(ids, "<u4"), right[b:]])
        if a == len(left) and b == len(right):
            return np.array(ids, "<u4")
        a, b = (a if fits_left else 2 * a), (b if fits_right else 2 * b)
        if fits_left and fits_right:
            a, b = 2 * a, 2 * b


def join_all(path: str, parts: list[np.ndarray]) -> np.ndarray:
    """Neighbours pairwise, level by level."""
    while len(parts) > 1:
        parts = [join(path, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode(path: str, texts: list[bytes], leaf: int) -> list[np.ndarray]:
    """Ids of each text: the parts of all texts are encoded in one go, then joined by text."""
    special = special_strings(path)
    parts = [halves(t, leaf) if not any(s in t for s in special) else [t] for t in texts]
    flat = iter(byte_ids(path, [p for row in parts for p in row], special))
    return [join_all(path, [np.frombuffer(next(flat), "<u4") for _ in row]) for row in parts]


def digests(path: str, ids: np.ndarray, names: list[bytes]) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids in decimal and of the decoded text."""
    table, row = token_bytes(path), ids.tolist()
    decoded = b"".join([table[i] for i in row])
    if not decoded.isascii():
        decoded = decoded.decode("utf-8", "replace").encode()
    return len(row), hashlib.sha256(b",".join([names[i] for i in row])).hexdigest(), hashlib.sha256(decoded).hexdigest()


def round_trip(docs: DataFrame, path: str, leaf: int = 4096, block: int = 1 << 16, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

    Texts of up to ``block`` code points are encoded where they are read, in parts of ``leaf`` bytes; longer
    ones in blocks of that size, each a row of its own, which meet again by row (not by doc_id, so repeated
    rows stay apart).  Texts holding a special string are never cut, as it could be cut in two.  Null text is
    empty: no ids, the digest of nothing; a null doc_id stays null; other columns are not read; an empty
    table gives no row.
    """
    from tokenizers import Tokenizer

    marks = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    rows = text_only(docs, text=text)
    cut = F.length("text") > block
    for m in marks:
        cut = cut & ~F.col("text").contains(m)

    def whole(batches):
        names = [str(i).encode() for i in range(len(token_bytes(path)))]
        for b in slices(batches, "text"):
            got = [digests(path, ids, names) for ids in encode(path, as_bytes(b.column("text")), leaf)]
            n, ids, dec = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(dec)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def part(batches):
        for b in slices(batches, "text"):
            ids = [x.tobytes() for x in encode(path, as_bytes(b.column("text")), leaf)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("at"), pa.array(ids, pa.binary())], names=["row", "doc_id", "at", "ids"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [str(i).encode() for i in range(len(token_bytes(path)))]
        pdf = pdf.sort_values("at")
        ids = join_all(path, [np.frombuffer(x, "<u4") for x in pdf["ids"]])
        key = pdf["doc_id"].iloc[0]
        return pd.DataFrame([(None if pd.isna(key) else int(key), *digests(path, ids, names))], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    short = rows.filter(~cut).mapInArrow(whole, SCHEMA)
    at = F.posexplode(F.expr(f"transform(sequence(0, (length(text) - 1) div {block}), i -> i * {block})")).alias("at", "from")
    blocks = rows.filter(cut).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text", at)
    blocks = blocks.select("row", "doc_id", "at", F.expr(f"substring(text, from + 1, {block})").alias("text"))
    long = blocks.repartition("row", "at").mapInArrow(part, "row long, doc_id long, at int, ids binary")
    return short.unionByName(long.groupBy("row").applyInPandas(meet, SCHEMA))
