"""Token ids of whole texts from a table of distinct words.

Splitting, taking words apart and looking the parts up is Arrow work over a slice
of rows; only parts that the worker has not met are encoded, so the cost per text
is that of its new parts.  The tables are bounded and go on from the last slice's
parts beyond their bound, which has no effect on results.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from blotter.llm.common import kept, runs

#: Words in a worker's table of ids (Arrow, some 30 bytes each) and parts of words in its dictionary (some 250 bytes each).
CACHE_WORDS, CACHE_PARTS = 400_000, 150_000
#: Runs of letters in a word encoder's table (Arrow, some 30 bytes each), and the other parts in a table of their own.
CACHE_RUNS, CACHE_RESTS = 200_000, 50_000
#: Parts that are encoded in one call; each has some hundred bytes of tokens, offsets and masks until its ids are read.
CALL = 4_096
#: Text bytes encoded at once: words, ids and their places take some thirty times as much while a slice is encoded.
ENCODE_BYTES = 3 << 20
#: A run of Latin letters and the punctuation after it.
RUN_AND_REST = "^(?P<run>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<rest>[!-/:-@\\[-`{-~]*)$"


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in set(plain)):
        table[chr(256 + i)] = b
    return table


class IdTable:
    """Distinct words and the ids of each; ``encode_new`` gives ids of words not met before.

    Beyond ``most`` words the table starts again, with ``recent`` from the words of the last lookup.  ``call`` words
    go to ``encode_new`` at once, all if None.
    """

    def __init__(self, encode_new: Callable[[list[str]], list], most: int = CACHE_WORDS, recent: bool = False, call: int | None = None):
        self.encode_new, self.most, self.recent, self.call = encode_new, most, recent, call
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.int32()))
        self.last = pa.array([], pa.int32())

    def encoded(self, new: pa.Array) -> pa.ListArray:
        ids = self.encode_new(new.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        return pa.ListArray.from_arrays(pa.array(runs(size).astype(np.int32)), pa.array(flat))

    def lookup(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word, row by row."""
        if len(self.words) > self.most:
            if self.recent and len(self.last) <= self.most:
                self.words, self.ids = self.words.take(self.last), self.ids.take(self.last)
            else:
                self.clear()
        coded = words.dictionary_encode()
        row = pc.index_in(coded.dictionary, value_set=self.words)
        if row.null_count:
            new = coded.dictionary.filter(row.is_null())
            step = self.call or len(new)
            more = [self.encoded(new.slice(i, step)) for i in range(0, len(new), step)]
            place = np.full(len(row), -1, np.int64)
            place[np.asarray(row.is_null())] = len(self.words) + np.arange(len(new))
            row = pc.coalesce(row, pa.array(place.astype(np.int32)))
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, *more])
        self.last = row
        return self.ids.take(row.take(coded.indices))


def end_to_end(a: pa.ListArray, b: pa.ListArray) -> pa.ListArray:
    """Row by row, the ids of ``a`` and then those of ``b``."""
    at = [np.asarray(x.offsets).astype(np.int64) for x in (a, b)]
    size = [np.diff(x) for x in at]
    ends = runs(size[0] + size[1])
    flat = np.empty(int(ends[-1]), np.int32)
    for x, n, start in zip((a, b), size, (ends[:-1], ends[:-1] + size[0]), strict=True):
        flat[np.repeat(start - runs(n)[:-1], n) + np.arange(int(n.sum()))] = np.asarray(x.flatten())
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def joined(per_word: pa.ListArray, words_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows whose words lie at words_at[i]:words_at[i + 1]: flat ids and n + 1 offsets."""
    at = np.asarray(per_word.offsets)
    return np.asarray(per_word.flatten()), (at[words_at] - at[0]).astype(np.int64)


class WordEncoder:
    """Ids by the tokenizers library, for vocabularies that drop white space and never merge across it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.runs = IdTable(self.new_runs, CACHE_RUNS, True, CALL)
        self.rests = IdTable(self.new_rests, CACHE_RESTS, True, CALL)

    def new_runs(self, lower: list[str]) -> list[list[int]]:
        """Ids of runs of lower-case Latin letters, by the library's model: normalising a run only lower-cases it, it is
        one piece, and its bytes have fixed stand-ins."""
        tokenize, stand_in = self.model.tokenize, self.stand_in
        return [[t.id for t in tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(stand_in))] if x else [] for x in lower]

    def new_rests(self, parts: list[str]) -> list[list[int]]:
        """Ids of any other parts, by the whole library."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def word_ids(self, words: pa.Array) -> pa.ListArray:
        """A run of Latin letters is split from the punctuation after it: the vocabulary's pattern never joins
        the two, and both recur far more often than the whole word.  All else goes through the whole library."""
        parts = pc.extract_regex(words, RUN_AND_REST)
        split = parts.is_valid()
        run = pc.if_else(split, pc.struct_field(parts, "run"), "")
        rest = pc.if_else(split, pc.struct_field(parts, "rest"), words)
        return end_to_end(self.runs.lookup(pc.utf8_lower(run)), self.rests.lookup(rest))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 offsets."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        return joined(self.word_ids(coded.dictionary).take(coded.indices), np.asarray(words.offsets) - words.offsets[0].as_py())


def word_encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary, while its tasks encode."""
    return kept(f"words:{path}", lambda: WordEncoder(path))
