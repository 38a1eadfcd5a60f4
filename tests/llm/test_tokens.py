"""Chunk memos of the token operators against the library on whole texts."""

import json
import random
import re

import public_tokenizers
import regex

from sitesift.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abCD'sStrevdml09 \t\n\x00\x01\x1c\x1f\x7f\x85.,!<|>/w&é́İſßǅ中‍  ²½٣"


def check(texts):
    raw = [t.encode() for t in texts]
    assert tokens.word_ids(PATH, raw) == tokens.packed_ids(PATH, raw)


def test_odd_characters():
    r = random.Random(5)
    check(["".join(r.choice(LETTERS) for _ in range(r.randrange(40))) for _ in range(5000)])


def test_special_strings_marks_and_long_words():
    check(["", " ", "<|endoftext|>", "a<|startoftext|>b é<|endoftext|>", "</w> </w>x", "'S''s'llx", "don'T", "\x01", "é\x01é \x01", "a" * 100_000, "'" * 5000, "é" * 5000])


def test_memo_that_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "_memos", {})
    tokens.memo("word", PATH, rows=50)
    monkeypatch.setattr(tokens, "PIECE_ROWS", 7)
    monkeypatch.setattr(tokens, "JOINED", 3)
    for at in range(0, 400, 40):
        check([f"word{i} other-{i % 7} é{i} x{i}!y" for i in range(at, at + 40)])


def test_vocabulary_without_word_ends_is_left_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokens.Pieces(path).usable
    assert tokens.chunk_ids(path, [b"one", b"two's"]) == tokens.packed_ids(path, [b"one", b"two's"])


def test_new_words_made_of_known_pre_tokens_are_not_encoded(monkeypatch):
    monkeypatch.setattr(tokens, "_memos", {})
    check(["café naïve it's 1 2 ( ) , .. ; \" ÀÉ"])
    text = '(Café, "naïve" ÀÉ;it\'S..12 àé,Café 2naïve)'
    want = tokens.packed_ids(PATH, [text.encode()])

    def refuse(*_):
        raise AssertionError("a known pre-token was encoded")

    for name in ("encode_all", "joined_ids"):
        monkeypatch.setattr(tokens, name, refuse)
    assert tokens.word_ids(PATH, [text.encode()]) == want


def test_pre_tokens_are_those_of_the_pattern():
    r = random.Random(8)
    texts = ["".join(r.choice("'''sSTtrevVELlmMdé×ÀßÿZ1.\" \n") for _ in range(r.randrange(30))) for _ in range(3000)]
    parts, first = tokens.cut_texts([t.encode() for t in texts], tokens.Pieces(PATH).special)
    got = [x.decode() for x in parts.to_pylist()]
    find = regex.compile(tokens.CUT_PATTERN).findall
    for t, a, b in zip(texts, first, first[1:], strict=False):
        assert got[a:b] == [p for w in t.split() for p in ([w] if "×" in w else find(w.lower()))], repr(t)


def test_long_texts_go_block_by_block(monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 9)
    monkeypatch.setattr(tokens, "BLOCKS", re.compile(rb"(?s).{9}\S*|.+").findall)
    check(["", " ", "é" * 50 + " it's  <|endoftext|>\n\n 12", "word " * 20 + "\x01 'S", "short", " " * 40])


def test_vocabulary_cut_by_another_pattern_is_left_to_the_library(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = [b"it's one, two  12", b"", b"Caf\xc3\xa9 it's"]
    assert not tokens.Pieces(path).usable
    assert tokens.word_ids(path, texts) == tokens.packed_ids(path, texts) != tokens.packed_ids(PATH, texts)
