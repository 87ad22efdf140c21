"""Token ids of whole texts by the ``tokenizers`` library, vectorised over Arrow buffers.

A byte-level BPE never merges across its pre-tokens. Text is therefore cut into runs at places where a pre-token always
begins, the distinct runs of a batch are encoded once by the library, and the ids of whole texts are gathered from them.
That holds for one kind of tokenizer file, which ``splits_at_words`` recognises; with any other file, and for texts that hold
the string of an added token, the library encodes the whole text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"
#: Distinct runs whose ids a Python worker remembers (some 250 bytes each); later ones are encoded again in each step that has them.
KEPT_RUNS = 600_000

_byte = np.arange(256)
_letter = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
_mark = (_byte > 0x20) & (_byte < 0x7F) & ~_letter & ~((_byte >= 48) & (_byte <= 57))
_blank = (_byte == 0x20) | (_byte == 0x0A)
# A byte that surely begins no white space: lead bytes of characters that may be white space in Unicode are left out.
_solid = ((_byte > 0x20) & (_byte < 0x7F)) | ((_byte >= 0x80) & ~np.isin(_byte, [0xC2, 0xE1, 0xE2, 0xE3]))


_one = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
# Byte-level models show a printable Latin-1 byte as itself and the others, in order, as the characters from 256 on.
_kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
_shown = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _kept)}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_words(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE that takes texts as they are and splits them by the usual pattern of words."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return plain and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and model.get("type") == "BPE" and not any(model.get(k) for k in odd)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where runs begin: at each text, before a blank that a solid byte of its own text follows, between an ASCII letter and a mark."""
    mark = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        left, right = data[:-1], data[1:]
        mark[: len(data) - 1] = _blank[left] & _solid[right]
        mark[1 : len(data)] |= _letter[left] & _mark[right]
    mark[offsets[1:] - 1] = False  # nothing follows a text's last byte
    mark[offsets] = True
    return np.flatnonzero(mark)


class Encoder:
    """Encodes columns of texts with the tokenizer file at ``path``.

    As in the library, the string of a special token gives that token's id wherever it stands; with ``special`` False it is ordinary text.
    """

    def __init__(self, path: str, special: bool = True, kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t["content"] for t in spec.get("added_tokens", []) if special or not t["special"]]
        self.by_runs = splits_at_words(spec)
        self.added = "|".join(map(re.escape, added))
        self.kept = KEPT_RUNS if kept is None else kept
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """Runs of Latin letters are one pre-token and go to the model itself, any other run to the whole tokenizer."""
        tokenize = self.tokenizer.model.tokenize
        out: list[list[int]] = [[t.id for t in tokenize(w.decode("latin-1").translate(_shown))] if _one(w) else [] for w in words]
        rest = [i for i, ids in enumerate(out) if not ids]
        found = self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            out[i] = e.ids
        return out

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word where its ids begin, how many they are, and the array that holds them."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        starts, lengths, pool = self.starts, self.lengths, self.pool
        if len(new):
            fresh = [words[i] for i in new]
            found = self._ids(fresh)
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(n.sum()))
            starts = np.concatenate([starts, len(pool) + np.cumsum(n) - n])
            lengths, pool = np.concatenate([lengths, n]), np.concatenate([pool, flat])
            at[new] = len(self.known) + np.arange(len(new))
            if len(starts) <= self.kept:
                self.known.update(zip(fresh, at[new].tolist(), strict=True))
                self.starts, self.lengths, self.pool = starts, lengths, pool
        return starts[at], lengths[at], pool

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and for n texts the n + 1 places where they begin and end. A null counts as empty."""
        texts = pa.concat_arrays([pa.compute.fill_null(texts, "").cast(pa.large_string())])
        whole = pa.compute.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        if not self.by_runs:
            whole = np.ones(len(texts), bool)
        if not whole.any():
            return self._by_runs(texts)
        found = self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        ids, offsets = self._by_runs(texts.filter(pa.array(~whole)))
        at = np.flatnonzero(~whole)
        parts: list[np.ndarray | list[int]] = [()] * len(texts)
        for i, a, b in zip(at.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts[i] = ids[a:b]
        for i, e in zip(np.flatnonzero(whole).tolist(), found, strict=True):
            parts[i] = e.ids
        return np.concatenate([np.asarray(p, np.uint32) for p in parts]), np.cumsum([0, *map(len, parts)])

    def _by_runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.concat_arrays([texts])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if not offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = texts.buffers()[2]
        cut = cuts(np.frombuffer(data, np.uint8)[: offsets[-1]], offsets)
        runs = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), data]).dictionary_encode()
        starts, n, pool = self._look_up(runs.dictionary.to_pylist())
        codes = runs.indices.to_numpy()
        lengths = n[codes]
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(cut, offsets)]


_encoders: dict[tuple[str, bool, int | None], Encoder] = {}


def encoder(path: str, special: bool = True, kept: int | None = None) -> Encoder:
    """One encoder for each Python worker and file."""
    if (path, special, kept) not in _encoders:
        _encoders[path, special, kept] = Encoder(path, special, kept)
    return _encoders[path, special, kept]
