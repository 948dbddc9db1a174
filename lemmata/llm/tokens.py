"""Ids by the tokenizers library, with each distinct chunk of text encoded once.

``Encoder`` cuts a batch of texts by its bytes: before a run of ASCII white space, before
one of ``.,!?;:`` after an ASCII letter, and between a lone line feed and an ASCII letter.
Neither of the two supported kinds of tokenizer joins characters across such a place, so
the ids of a text are those of its chunks.  Cutting, finding the distinct chunks and
putting their ids together run in numpy and Arrow; Python sees distinct chunks only.
The ids of chunks are kept, up to ``most`` of them and those of one part; long chunks are encoded as they come.
The tokenizer's file is read on the driver and sent to the workers.  A file of another kind
than those two is not cut: the library then encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

T = TypeVar("T")

#: Unicode's White_Space, as the tokenizers' own patterns have it (Python's \s has four more).
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
FAST = re.compile(r"\s*\S+|\s+")
ODD = re.compile("[\x1c-\x1f]")
SPACE_SET = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Latin letters, perhaps after a space (all stable under NFC, none that lower-casing splits).
SIMPLE = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u01c3\u01cd-\u01f0\u01f4-\u024f]{1,40}")
#: Longer chunks aren't kept.
LONG = 64
#: Bytes of text that are cut at once (or one text, if that is longer), by default.
PART = 4 << 20


def byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


BLANKS = byte_set("\t\n\v\f\r ")
STOPS = byte_set(".,!?;:")
LETTERS = byte_set("".join(chr(x) for a in "Aa" for x in range(ord(a), ord(a) + 26)))


def file_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> bytes:
    return Path(path).read_bytes()


def byte_letters() -> dict[str, int]:
    """Letter -> byte, by the rule of the vocabulary's file: printable bytes stand for
    themselves, the others take the letters from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunks(text: str) -> list[str]:
    """Runs of white space, each with what follows up to the next."""
    return (CHUNK if ODD.search(text) else FAST).findall(text)


def cut(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts in UTF-8 begin, and the end; each offset is among them."""
    if not len(buf):
        return np.zeros(1, np.int64)
    blank = BLANKS[buf]
    before, here = buf[:-1], buf[1:]
    ascii_word = ~blank[:-1] & (before < 128)
    starts = ascii_word & blank[1:]
    # after other characters too, but not within a run that a rarer white space began
    for i in np.flatnonzero(blank[1:] & (before >= 128)).tolist():
        if bytes(buf[max(0, i - 2) : i + 1]).decode("utf-8", "ignore")[-1:] not in SPACE_SET:
            starts[i] = True
    starts |= LETTERS[before] & STOPS[here]
    starts[1:] |= ascii_word[:-1] & (before[1:] == 10) & LETTERS[here[1:]]
    mark = np.zeros(len(buf) + 1, bool)
    mark[1:-1] = starts
    mark[offsets] = True
    return np.flatnonzero(mark)


_kept: dict[tuple, object] = {}


def kept(kind: Callable[..., T], data: bytes, **how) -> T:
    """One object a Python worker for the same data: later tasks find what earlier ones
    learned, and it isn't built again for each task."""
    key = (kind.__name__, hashlib.sha256(data).digest(), *sorted(how.items()))
    if key not in _kept:
        _kept.clear()
        _kept[key] = kind(data, **how)
    return _kept[key]


# What the files of the two supported kinds say besides their vocabularies.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {**BYTE_LEVEL, "use_regex": False},
    ],
}


def cuts_hold(spec: dict) -> bool:
    """Is this a tokenizer that never joins characters across a cut?"""
    model, added = spec["model"], spec.get("added_tokens") or []
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return False
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s|[A-Za-z][.,!?;:]", t["content"]) for t in added):
        return False
    bytes_ = spec["normalizer"] is None and spec["pre_tokenizer"] == BYTE_LEVEL and not model.get("end_of_word_suffix")
    return bytes_ or (spec["normalizer"] == WORD_NORMALIZER and spec["pre_tokenizer"] == WORD_SPLIT)


class Encoder:
    """``ids(texts)``: each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, data: bytes, most: int = 1_000_000, part: int = PART):
        self.tok = Tokenizer.from_buffer(data)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.most, self.part_bytes, self.known, self.old = most, part, {}, {}
        spec = json.loads(data)
        self.cuts = cuts_hold(spec)
        self.lower = bool(spec["normalizer"])
        self.model = self.tok.model
        letter = {b: c for c, b in byte_letters().items()}
        #: How the model's vocabulary spells the letters of SIMPLE and the space.
        self.spell = {x: "".join(letter[b] for b in chr(x).encode()) for x in (32, *range(128, 0x250))}

    def learn(self, new: list[str]) -> None:
        """Adds the ids of chunks.  Words of Latin letters go to the library's model as they
        are: its patterns make one piece of each.  All others take the library's whole way."""
        known, rest, model, spell, space = self.known, [], self.model, self.spell, self.spell[32]
        for c in new:
            if not SIMPLE.fullmatch(c):
                rest.append(c)
                continue
            w = c
            if self.lower:
                # a space before a word gives no ids, and most words have one
                w = " " + c.lstrip(" ").lower()
                if (again := known.get(w)) is not None:
                    known[c] = again
                    continue
            piece = w[1:] if self.lower else w
            piece = piece.replace(" ", space) if piece.isascii() else piece.translate(spell)
            ids = [t.id for t in model.tokenize(piece)]
            known[c] = known[w] = struct.pack(f"<{len(ids)}I", *ids)
        if rest:
            self.encode(rest)

    def encode(self, chunks: list[str]) -> None:
        """Adds the chunks' ids.  Many chunks are encoded as one text, each at a line's
        start; the tokens' offsets tell which chunk has them."""
        plain = [c for c in chunks if c[-1] not in SPACE_SET]
        for c in chunks:
            if c[-1] in SPACE_SET:
                self.known[c] = np.array(self.tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        groups, size = [[]], 0
        for c in plain:
            if size > 4000:
                groups.append([])
                size = 0
            groups[-1].append(c)
            size += len(c)
        groups = [g for g in groups if g]
        lines = ["".join([c if c[0] in SPACE_SET else f"\n{c}" for c in g]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch(lines, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            start = np.array([a for a, _ in e.offsets], np.int64)
            ends = np.cumsum([len(c) + (c[0] not in SPACE_SET) for c in g])
            own = np.searchsorted(ends, start, side="right")
            # the line feed that was put before a chunk isn't its own
            put = np.array([c[0] not in SPACE_SET for c in g])
            first = ends - np.array([len(c) for c in g]) - put
            drop = put[own] & (start == first[own])
            ids, own = ids[~drop], own[~drop]
            at = np.searchsorted(own, np.arange(len(g) + 1))
            raw = ids.tobytes()
            self.known.update(zip(g, [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], strict=True))

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        array = pc.fill_null(array.cast(pa.large_string()), "")
        if not self.cuts:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(array.to_pylist(), add_special_tokens=False)]
        if not pc.sum(pc.binary_length(array)).as_py():
            return [b""] * len(array)
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        buf, out, at = np.frombuffer(array.buffers()[2], np.uint8), [], 0
        while at < len(array):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.part_bytes, side="right")) - 1)
            out += self.part(buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
        return out

    def part(self, buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of the texts that lie at ``offsets`` in ``buf``."""
        if len(self.known) > self.most // 2:
            # what isn't met again until the next time goes
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        starts = cut(buf, offsets)
        found = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(buf)).dictionary_encode()
        own = found.dictionary.to_pylist()
        got = list(map(known.get, own))
        if new := [c for c, ids in zip(own, got, strict=True) if ids is None]:
            known.update([(c, ids) for c, ids in zip(new, map(old.get, new), strict=True) if ids is not None])
            self.learn([c for c in new if c not in known])
            got = list(map(known.__getitem__, own))
            for c in new:
                if len(c) > LONG:
                    known.pop(c, None)
        ids = pa.array(got, pa.large_binary()).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][np.searchsorted(starts, offsets)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
