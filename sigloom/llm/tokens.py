"""Token ids of whole texts with a public tokenizer file.

The word tokenizer normalises, cuts at white space and never joins across it, so the ids of a text are the ids of its
white-space-separated chunks in order. Chunks repeat, so a worker remembers the ids of those it has met (when
there are more than `REMEMBERED` it starts anew) and hands only new ones to the library. Special tokens written in a text are matched
by the library inside their chunk, as in the whole text.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

REMEMBERED = 1_200_000
END_ID = 1
_MARKS = ".,;:!?|#$%&*)"
assert array("I").itemsize == 4 and sys.byteorder == "little"
_CUT = re.compile(r"[ \t\n\r]+")
#: What the word tokenizer's file says of normalising and cutting, on which the short way below rests.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_tokenizers: dict[str, object] = {}
_by_word: dict[str, bool] = {}
_known: dict[str, dict[str, bytes]] = {}
_tables: dict[str, dict[int, str]] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def by_word(path: str) -> bool:
    """Whether a file is a word tokenizer of this kind: its texts may be encoded a white-space-separated chunk at a time."""
    if path not in _by_word:
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        cut = about.get("pre_tokenizer") or {}
        special = all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) and not any(map(str.isspace, t["content"])) for t in about.get("added_tokens") or [])
        _by_word[path] = special and about.get("normalizer") == WORD_NORMALIZER and cut.get("pretokenizers") == [WORD_SPLIT, WORD_BYTES] and not about.get("truncation") and not about.get("padding")
    return _by_word[path]


def _parts(chunk: str) -> tuple[str, ...]:
    """Pieces of a chunk that the library encodes independently: letter case of ASCII is dropped, and marks after a
    letter at the end are words of their own for it. What may hold a special token stays as it is."""
    if "<|" in chunk:
        return (chunk,)
    if chunk.isascii():
        chunk = chunk.lower()
    stem = chunk.rstrip(_MARKS)
    # a letter that may turn into a letter and a mark, by its lower case or its normal form, isn't cut from what follows
    plain = stem != chunk and stem[-1:].isalpha() and stem[-1] < "\u0250" and stem[-1] != "\u0130"
    return (stem, chunk[len(stem) :]) if plain else (chunk,)


def _word_table(path: str) -> dict[int, str]:
    """What the library's byte-level step makes of Latin letters that have one lower case and one normal form."""
    if path not in _tables:
        cut = tokenizer(path).pre_tokenizer.pre_tokenize_str
        _tables[path] = {c: cut(chr(c))[0][0] for c in range(0xAA, 0x250) if chr(c).isalpha() and chr(c).lower() == chr(c)}
    return _tables[path]


def _learn(new: set[str], known: dict[str, bytes], path: str) -> None:
    """Plain words go straight to the library's model, which is what its pipeline would hand it; all else goes through
    the whole pipeline."""
    cut = {c: _parts(c) for c in new}
    table, tokenize, rest = _word_table(path), tokenizer(path).model.tokenize, []
    for part in {p for ps in cut.values() for p in ps if p not in known}:
        if part.isalpha() and part.isascii():
            known[part] = array("I", [t.id for t in tokenize(part.lower())]).tobytes()
        elif (word := part.lower()).isalpha() and len(word) == len(part) and max(word) < "\u0250":
            known[part] = array("I", [t.id for t in tokenize(word.translate(table))]).tobytes()
        else:
            rest.append(part)
    for at in range(0, len(rest), 10_000):
        part = rest[at : at + 10_000]
        for chunk, e in zip(part, tokenizer(path).encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[chunk] = array("I", e.ids).tobytes()
    for chunk, parts in cut.items():
        if chunk not in known:
            known[chunk] = b"".join([known[p] for p in parts])


def _chunks(text: str) -> list[str]:
    # str.split cuts where the library sees white space, and at four control characters more
    return _CUT.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def encode(texts: list[str | None], path: str, end_id: int | None = END_ID) -> list[bytes]:
    """For each text its ids as little-endian unsigned 32-bit integers, then the end id. Null counts as empty. A file that is
    no word tokenizer encodes whole texts."""
    if not by_word(path):
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        return [array("I", e.ids).tobytes() + end for e in tokenizer(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    chunks = [_chunks(t) if t else [] for t in texts]
    found = [list(map(known.get, cs)) for cs in chunks]
    new = {c for cs, ids in zip(chunks, found, strict=True) if None in ids for c, i in zip(cs, ids, strict=True) if i is None}
    if new:
        _learn(new, known, path)
        found = [[known[c] if i is None else i for c, i in zip(cs, ids, strict=True)] if None in ids else ids for cs, ids in zip(chunks, found, strict=True)]
    return [b"".join(ids) + end for ids in found]
