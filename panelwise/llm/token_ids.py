"""Token ids of whole texts by a public tokenizer, with a worker's cache of words.

The tokenizer drops white space, so no token spans it and a text's ids are
those of its words in order.  A block of texts is split by Arrow, its
distinct words are parted into runs of letters and the punctuation after
them, and only runs that the cache lacks are encoded; numpy then lays the ids
of all words out in the order of the texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelwise.llm.shared import ship_by_value, worker_cache

#: Runs of letters, and other words, whose ids a worker keeps, in each of two generations (about 200 bytes each).
CACHED_WORDS = 200_000
#: Bytes of the texts that are split at once.
BLOCK_BYTES = 1 << 22
#: ASCII punctuation but the apostrophe, which starts tokens that hold letters.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS_BEFORE = r"^[^!-&(-/:-@\[-`{-~]*"
#: Characters that Arrow takes for spaces and the tokenizer doesn't.
SEPARATORS = r"[\x1C-\x1F]"
#: Beyond these, a letter's lower case may depend on its neighbours or be composed anew.
BEYOND_LATIN = r"[^\x{0}-\x{FF}]"
#: Words that are encoded in one call.
JOINED_WORDS = 256


def _gathered(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``codes`` name, in their order, and the length of each."""
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(total)], each


class WordIds:
    """Ids of texts as unsigned 32-bit numbers."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached_words = cached_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; none for null."""
        texts = texts.cast(pa.string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
            yield from self._of_block(texts.slice(at, end - at))
            at = end

    def of_text(self, text: str | None) -> np.ndarray:
        return next(self.of_column(pa.array([text], pa.string())))

    def _of_block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        apart = pc.match_substring_regex(texts, SEPARATORS)
        plain = pc.if_else(apart, "", texts)
        plain = pc.if_else(pc.match_substring_regex(plain, BEYOND_LATIN), plain, pc.utf8_lower(plain))
        split = pc.utf8_split_whitespace(plain)
        coded = split.flatten().filter(pc.not_equal(split.flatten(), "")).dictionary_encode()
        # the number of words of each text: leading and trailing spaces give empty ones
        empty = pc.equal(split.flatten(), "").to_numpy(zero_copy_only=False)
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        before = np.concatenate([[0], np.cumsum(~empty)])[offsets]
        ids, each = self._of_words(coded)
        ends = np.concatenate([[0], np.cumsum(each)])[before]
        whole = iter(self.encoded([t for t in texts.filter(apart).to_pylist()]))
        for i, alone in enumerate(apart.to_pylist()):
            yield np.frombuffer(next(whole), "<u4") if alone else ids[ends[i]:ends[i + 1]]

    def _of_words(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        distinct = coded.dictionary
        core = pc.utf8_rtrim(distinct, characters=PUNCTUATION)
        letters = pc.utf8_is_alpha(core)
        core = pc.if_else(letters, core, distinct).dictionary_encode()
        tail = pc.if_else(letters, pc.replace_substring_regex(distinct, LETTERS_BEFORE, ""), "").dictionary_encode()
        units = core.dictionary.to_numpy(zero_copy_only=False).tolist() + tail.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.ids_of(units)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        pairs = np.empty(2 * len(distinct), np.int64)
        pairs[0::2] = core.indices.to_numpy()
        pairs[1::2] = tail.indices.to_numpy() + np.int64(len(core.dictionary))
        flat, each = _gathered(flat, lengths, pairs)
        return _gathered(flat, each[0::2] + each[1::2], coded.indices.to_numpy())

    def ids_of(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units, from the young generation, the old one, or encoded anew."""
        if len(self.young) > self.cached_words:
            self.old, self.young = self.young, {}
        missing = set(units).difference(self.young)
        kept = missing.intersection(self.old)
        self.young.update((u, self.old[u]) for u in kept)
        new = list(missing - kept)
        letters, others = [u for u in new if u.isalpha()], [u for u in new if not u.isalpha()]
        self.young.update(zip(letters, self.encoded_letters(letters)))
        self.young.update(zip(others, self.encoded(others)))
        return list(map(self.young.__getitem__, units))

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_letters(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters, joined by spaces for one call and parted by the numbers of their words."""
        found: list[bytes] = []
        for at in range(0, len(runs), JOINED_WORDS):
            part = runs[at:at + JOINED_WORDS]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            number, data = np.asarray(e.word_ids, np.int64), np.asarray(e.ids, "<u4").tobytes()
            starts = np.flatnonzero(np.diff(number, prepend=-1)) * 4
            if len(starts) != len(part):  # a letter that the tokenizer doesn't take for one
                found += self.encoded(part)
            else:
                found += [data[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(data)])]
        return found


def word_ids(path: str) -> WordIds:
    """The worker process's cache; this module is pickled by value, so its own globals are new in each task."""
    kept = worker_cache("token_ids")
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


ship_by_value(__name__)
