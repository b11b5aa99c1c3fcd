"""Words of a text, however it is marked up, spelled or spaced."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|sup|sub|mark|small|code|font)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!]?[a-z][^<>]*>", re.I)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Without markup, entities and hidden characters; compatibility forms unified."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return text if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFKC", text))


def folded(text: str) -> str:
    """:func:`plain` in one letter case and without accents."""
    text = plain(text).casefold()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Folded words; any mark that is neither letter nor digit parts two words."""
    return _WORD.findall(folded(text))


@dataclass(frozen=True)
class Batch:
    """The words of many texts: the words of text i are vocabulary[codes[starts[i]:starts[i + 1]]]."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: list[str]

    def of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def where(texts: pa.Array, mask: pa.Array, change) -> pa.Array:
    """``texts`` with ``change`` applied to those of ``mask``."""
    return pc.replace_with_mask(texts, mask, change(texts.filter(mask))) if pc.any(mask).as_py() else texts


def unescaped(texts: pa.Array) -> pa.Array:
    """Texts without entities."""
    return where(texts, pc.match_substring(texts, "&"), lambda t: pa.array([html.unescape(x) for x in t.to_pylist()], t.type))


def without(texts: pa.Array, *patterns: tuple[str, str]) -> pa.Array:
    """Texts with each pattern replaced, one after the other."""
    for pattern, by in patterns:
        texts = pc.replace_substring_regex(texts, pattern, by)
    return texts


def parted(texts: pa.Array, keep: str = "") -> Batch:
    """Words of texts in lower case, split at all that is neither letter nor digit nor in ``keep`` (ASCII characters)."""
    t = where(texts, pc.invert(pc.string_is_ascii(texts)), lambda x: without(x, (r"[^\pL\pN\x00-\x7F]+", " ")))
    t = pa.concat_arrays([t]) if not t.offset else pa.concat_arrays([t.slice(0, 0), t])
    table = np.arange(256, dtype=np.uint8)
    table[:128] = [ord(c.lower()) if c.isalnum() or c in keep else 32 for c in map(chr, range(128))]
    _, offsets, data = t.buffers()
    blank = pa.py_buffer(table[np.frombuffer(data, np.uint8)]) if data is not None and data.size else data
    t = pc.utf8_trim(pa.LargeStringArray.from_buffers(len(t), offsets, blank), " ")
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(t, ""), None, t))
    coded = lists.flatten().dictionary_encode()
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return Batch(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), coded.dictionary.to_pylist())


def word_batch(texts: pa.Array) -> Batch:
    """:func:`words` of many texts at once, the same words; a null text has none."""
    t = unescaped(texts.fill_null("").cast(pa.large_string()))
    t = where(t, pc.match_substring(t, "<"), lambda x: without(x, ("(?i)" + _INLINE.pattern, ""), ("(?i)" + _TAG.pattern, " ")))
    t = where(t, pc.invert(pc.string_is_ascii(t)), _folded)
    return parted(t)


def _folded(t: pa.Array) -> pa.Array:
    lower = without(pc.utf8_lower(without(pc.utf8_normalize(t, "NFKC"), (_HIDDEN.pattern, ""))), ("ß", "ss"), ("ς", "σ"))
    return without(pc.utf8_normalize(lower, "NFKD"), (r"\p{Mn}", ""))
