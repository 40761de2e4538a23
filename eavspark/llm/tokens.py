"""Token ids by the tokenizers library, at the speed of a dictionary.

Both vocabularies split a text into pieces whose ids don't depend on their
neighbours, so each piece goes to the library's merges once and is then looked up. The
pieces of many texts are found at once, in arrays, and looked up once for all of them. Texts
with characters outside ``PLAIN``, where the library's tables and Python's could
differ, and texts that hold a special token's name go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters for which splitting, lowering and composing here and in the library are the same by construction:
#: up to the end of Latin Extended-A, without controls and the one letter that lowers to two characters.
ODD = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-ſ]")
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: How the vocabularies split, by the pattern in their files: the byte-level one, and the one for lower-case words. ``starts`` does the same.
BYTE_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
#: What each character is, as far as PLAIN goes.
KINDS = np.array([next(k for k, x in enumerate((rf"[{LETTER}]", rf"[{NUMBER}]", r"\s", "(?s:.)")) if re.match(x, chr(c))) for c in range(0x180)], np.uint8)
DIGIT, WHITE = 1, 2
#: Rows and UTF-8 bytes of texts that are encoded at once; a longer text is alone.
ROWS, BYTES = 2048, 1 << 22
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Cached pieces, and the longest that are cached; a full cache starts anew, which costs time only.
MOST, LONGEST = 500_000, 64


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


LETTERS = byte_letters()
#: The letters of all bytes in order, for a decoder of single bytes.
TABLE = "".join(chr(LETTERS.get(b, b)) for b in range(256))
#: Packers of few ids, by how many.
PACK = [struct.Struct(f"<{n}H").pack for n in range(32)]


class Ids(dict):
    """A piece to its ids, as little-endian 16-bit bytes."""

    def __init__(self, tokenizer):
        self.merges = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        found = [t.id for t in self.merges(charmap_decode(piece.encode(), "strict", TABLE)[0])]
        ids = PACK[len(found)](*found) if len(found) < len(PACK) else struct.pack(f"<{len(found)}H", *found)
        if len(piece) <= LONGEST:
            if len(self) >= MOST:
                self.clear()
            self[piece] = ids
        return ids


def kind(path: str) -> str | None:
    """``byte`` or ``word`` by a vocabulary file's own normaliser and splitter; None for any other."""
    with open(path) as f:
        held = json.load(f)
    model, before, split = held["model"], held["normalizer"], held["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if plain and before is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]:
        return "byte"
    steps, parts = [x["type"] for x in (before or {}).get("normalizers", [])], split.get("pretokenizers", [])
    if plain and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]:
        if parts[0]["pattern"].get("Regex") == WORD_PATTERN and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            return "word"
    return None


@functools.lru_cache(maxsize=4)
def encoders(path: str):
    """``encode(texts) -> list of bytes`` (little-endian 16-bit ids) for a vocabulary file; one a worker.

    The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, which
    takes a special token's name in a text for that token.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids of more than 16 bits are not supported")
    named = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
    quick = {t.content[:1] for t in tokenizer.get_added_tokens_decoder().values()}
    quick = quick.pop() if len(quick) == 1 and quick <= {*"<[|"} else ""
    cache, of = Ids(tokenizer), kind(path)

    def encode(texts: list[str]) -> list[bytes]:
        out, plain = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if of is None or ODD.search(text) or quick in text and named.search(text):
                out[k] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
            elif text:
                plain.append(k)
        if plain:
            raw = [(texts[k] if of == "byte" else texts[k].lower()).encode() for k in plain]
            ends, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
            at = np.append(np.flatnonzero(starts(data, ends[:-1], of)), len(data))
            pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
            # the ids of all pieces, one after the other, are the data of the array of them
            names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = pa.array([cache[x] if of == "byte" or not x.isspace() else b"" for x in names], pa.large_binary()).take(pieces.indices)
            places, held = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(at, ends)].tolist(), memoryview(ids.buffers()[2])
            for k, a, b in zip(plain, places, places[1:]):
                out[k] = held[a:b].tobytes()
        return out

    return encode


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """``encode(text) -> bytes``, as ``encoders`` gives them for many texts."""
    encode = encoders(path)
    return lambda text: encode([text])[0]


def starts(data: np.ndarray, begins: np.ndarray, of: str) -> np.ndarray:
    """Whether a piece begins at each byte of texts of PLAIN characters, one after the other and none empty, that begin at ``begins``.

    The pieces are those of BYTE_SPLIT, or those of WORD_SPLIT (in lower case) and the white space between them.
    """
    kinds = KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    kinds[lead] = kinds[lead + 1] = KINDS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    first = np.zeros(len(data) + 3, bool)
    first[begins] = True
    new = first.copy()
    new[1 : len(data)] |= kinds[1:] != kinds[:-1]
    if of == "byte":
        # the last of the white space before something else is cut off, and goes with that if it is a space
        white = kinds == WHITE
        after = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        after = after[~first[after]]
        new[after - 1] = True
        new[after] = data[after - 1] != ord(" ")
    else:
        new[: len(data)] |= (kinds == DIGIT) & (data & 0xC0 != 0x80)
    quotes = np.flatnonzero(new[: len(data)] & (data == ord("'")))
    if len(quotes):
        data = np.append(data, np.zeros(3, np.uint8))
        x, y = data[quotes + 1], data[quotes + 2]
        one = ~first[quotes + 1] & np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ~first[quotes + 1] & ~first[quotes + 2] & ((x == ord("r")) & (y == ord("e")) | (x == ord("v")) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
        new[quotes[one | two] + 1] = False
        new[quotes[one] + 2] = True
        new[quotes[two] + 3] = True
    return new[: len(kinds)]


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of what is encoded at once."""
    upto = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)))
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(upto, upto[row] + BYTES, "right")) - 1
        end = max(row + 1, min(end, row + ROWS, len(texts)))
        yield row, end - row
        row = end


def path(name: str) -> str:
    """Where a vocabulary file lies; the default of the operators' parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)
