"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A short word is one row of two small arrays: the ids of its parts in order and,
for each part, the merge rank of it and its right neighbour.  A step scans the
row for the least rank (the leftmost of equal ones), merges there, deletes that
boundary by shifting the rest of the row and refreshes the two neighbouring
ranks; a row is done when no rank is left.  The rows of all new words of a slice
advance together, word by length class.  Words above ``LONG`` bytes (no space
for thousands of characters) hold parts in a linked list with a heap of ranks.

Every text is encoded whole.  Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from blotter.llm.common import docs_of, gather, list_of, map_slices, runs
from blotter.llm.tokens import CACHE_PARTS, IdTable, byte_alphabet, default_vocabulary, joined

#: Bytes of a word up to which it is a row of a rank array.
LONG = 48
#: Unicode's White_Space, and the byte-level split pattern of the public vocabulary over it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
           rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space that is not followed by something visible (control separators count as white space here).
ODD_SPACE = (r" (?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)")
NONE = np.int32(2**31 - 1)


class RankArrayBpe:
    """Encoder and decoder over a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in tok) for tok, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for tok, i in self.special.items():
            self.bytes_of[i] = tok.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = [(vocab[a] << 20 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)]
        pairs.sort()
        self.pair = np.array([p[0] for p in pairs] + [2**62], np.int64)
        self.rank = np.array([p[1] for p in pairs] + [NONE], np.int32)
        self.by_rank = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.lookup = {k: (r, i) for k, r, i in pairs}
        size = max(self.bytes_of) + 1
        table = [self.bytes_of.get(i, b"") for i in range(size)]
        self.out_len = np.fromiter(map(len, table), np.int64, size)
        self.out_start = runs(self.out_len)[:-1]
        self.out_flat = np.frombuffer(b"".join(table), np.uint8)
        self.split = regex.compile(PATTERN, regex.V0)
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cores: dict[str, np.ndarray] = {}
        self.first = IdTable(self.new_words)
        self.later = IdTable(lambda words: self.new_words([f" {w}" for w in words]))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of parts, NONE where there is none."""
        key = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], NONE)

    def short_words(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of equal length; returns the parts (left-aligned) and how many are left per row."""
        n, width = parts.shape
        left = np.full(n, width, np.int64)
        if width == 1:
            return parts, left
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.ranks_of(parts[:, :-1], parts[:, 1:])
        rows, cols = np.arange(n), np.arange(width)
        live_parts, live_ranks = parts, ranks
        done = parts.copy()
        while len(rows):
            at = live_ranks.argmin(axis=1)
            least = live_ranks[np.arange(len(rows)), at]
            more = least != NONE
            if not more.all():
                ended = ~more
                done[rows[ended], : live_parts.shape[1]] = live_parts[ended]
                rows, at, least = rows[more], at[more], least[more]
                live_parts, live_ranks = live_parts[more], live_ranks[more]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            # delete the boundary after position `at`: everything right of it moves one place left
            width = live_parts.shape[1]
            take = np.minimum(cols[:width] + (cols[:width] > at[:, None]), width - 1)
            live_parts = np.take_along_axis(live_parts, take, 1)[:, : width - 1]
            live_ranks = np.take_along_axis(live_ranks, take, 1)[:, : width - 1]
            live_parts[k, at] = self.by_rank[least]
            left[rows] -= 1
            # refresh the ranks of the new part with its right and left neighbours
            has = at + 1 < left[rows]
            right = np.minimum(at + 1, width - 2)
            live_ranks[k, at] = np.where(has, self.ranks_of(live_parts[k, at], live_parts[k, right]), NONE)
            has = at > 0
            before = np.maximum(at - 1, 0)
            fresh = self.ranks_of(live_parts[k, before], live_parts[k, at])
            live_ranks[k[has], before[has]] = fresh[has]
        return done, left

    def long_word(self, data: bytes) -> list[int]:
        """Linked list of parts and a heap of (rank, position)."""
        part = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(part)
        nxt, prev, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        get = self.lookup.get
        heap = [(r[0], i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] << 20 | part[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j < 0 or part[i] != a or part[j] != b:
                continue
            part[i] = get(a << 20 | b)[1]
            gone[j] = True
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if r := get(part[i] << 20 | part[k]):
                    heapq.heappush(heap, (r[0], i, part[i], part[k]))
            h = prev[i]
            if h >= 0 and (r := get(part[h] << 20 | part[i])):
                heapq.heappush(heap, (r[0], h, part[h], part[i]))
        return [part[i] for i in range(n) if not gone[i]]

    def merge(self, pieces: list[str]) -> None:
        """Ids of new pieces into ``cores``, by byte length."""
        data = [p.encode() for p in pieces]
        size = np.fromiter(map(len, data), np.int64, len(data))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            if n > LONG:
                for i in at.tolist():
                    self.cores[pieces[i]] = self.long_word(data[i])
                continue
            for block in np.array_split(at, max(1, len(at) * n // 400_000)):
                raw = np.frombuffer(b"".join([data[i] for i in block.tolist()]), np.uint8).reshape(len(block), n)
                parts, left = self.short_words(self.byte_id[raw])
                for i, row, m in zip(block.tolist(), parts.tolist(), left.tolist(), strict=True):
                    self.cores[pieces[i]] = row[:m]

    def new_words(self, words: list[str]) -> list[list[int]]:
        """Ids of stretches of text that no piece crosses."""
        if len(self.cores) > CACHE_PARTS:
            self.cores.clear()
        split = [self.pieces(w) for w in words]
        known = self.cores
        self.merge(list({p for x in split for p in x if p not in known and isinstance(p, str)}))
        for i in self.special.values():
            known[i] = [i]
        return [known[x[0]] if len(x) == 1 else [i for p in x for i in known[p]] for x in split]

    def pieces(self, text: str) -> list:
        """Pieces of a text in order; a special token is its id."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self.split.findall(text[at:m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 offsets.

        No piece crosses a space that is followed by anything but white space or the end: the space belongs
        to the piece after it.  Texts are cut there; in the few that hold other spaces, only there.
        """
        odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE), dtype=bool)
        cut = pc.split_pattern(texts, " ")
        if odd.any():
            rows = [regex.split(r" (?=\S)", t) for t in texts.filter(pa.array(odd)).to_pylist()]
            cut = pa.concat_arrays([cut.filter(pa.array(~odd)), pa.array(rows, cut.type)])
            back = np.empty(len(odd), np.int64)
            back[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(odd))
            cut = cut.take(pa.array(back))
        at = np.asarray(cut.offsets).astype(np.int64)
        at, words = at - at[0], cut.flatten()
        starts = np.zeros(len(words), bool)
        starts[at[:-1]] = True
        later = self.later.lookup(words.filter(pa.array(~starts)))
        first = self.first.lookup(words.filter(pa.array(starts)))
        place = np.where(starts, len(later) + np.cumsum(starts) - 1, np.cumsum(~starts) - 1)
        return joined(pa.concat_arrays([later, first]).take(pa.array(place)), at)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; ids that break a character give the replacement character."""
        raw = gather(self.out_flat, self.out_start[ids], self.out_len[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode()


_ENCODERS: dict[str, RankArrayBpe] = {}


def encoder(path: str) -> RankArrayBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = RankArrayBpe(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>), a row per input row; empty and null texts give no ids."""
    path = vocabulary or default_vocabulary("byte_bpe_50k.json")

    def make():
        bpe = encoder(path)

        def work(batch):
            ids, at = bpe.encode(batch.column(1))
            return {"doc_id": batch.column(0),
                    "ids": list_of(ids, at, pa.int32())}
        return work

    return map_slices(docs_of(docs), make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, text); ids outside the vocabulary raise."""
    path = vocabulary or default_vocabulary("byte_bpe_50k.json")

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)).decode()
                     for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without moving the ids.

    One row per input row, repeated rows too; null text counts as empty (0 tokens, digests of nothing).
    """
    path = vocabulary or default_vocabulary("byte_bpe_50k.json")

    def make():
        bpe = encoder(path)

        def work(batch):
            ids, at = bpe.encode(batch.column(1))
            ends = at.tolist()
            spans = list(zip(ends, ends[1:], strict=False))
            wide = ids.astype("<u4")
            return {"doc_id": batch.column(0), "n_tokens": np.diff(at),
                    "ids_sha256": [hashlib.sha256(wide[a:b]).hexdigest() for a, b in spans],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(ids[a:b])).hexdigest() for a, b in spans]}
        return work

    return map_slices(docs_of(docs), make,
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
