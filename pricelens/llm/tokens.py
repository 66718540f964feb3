"""Token ids of listing texts by a public tokenizer file that takes white space for a word boundary."""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
SLICE = 1 << 22
END = 2  # closes every document of a packed sequence


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _of_letters(word: bytes) -> bool:
    """Whether a word of UTF-8 holds letters alone, of whatever script, composed and lowered, too, as the tokenizer does it."""
    return word.isalpha() or (not word.isascii() and normalize("NFC", word.decode()).lower().isalpha())


class WordEncoder:
    """Encodes texts word by word and remembers words: no token of the tokenizer spans white space, so the ids of a text
    are those of its words in turn. A word that ends in an ASCII letter or digit, or is of letters alone, and then stops is encoded
    as these two parts, for the tokenizer always parts them, too; it lowers letters itself. Memory is bounded by KEPT words."""

    KEPT = 600_000
    STOPS = b".,!?;:*%$#&"
    ENDS = "([0-9a-zà-öø-ÿ])([.,!?;:*%$#&])"  # the tokenizer always parts these two, so a blank between them changes no id

    def __init__(self, path: str, ordinary_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary_specials
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that end a run of letters
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def _learn(self, unknown: list[bytes]) -> None:
        """Ids of many words. Words of letters are one run each: they go into one call, blanks between them."""
        letters, others = [], []
        for w in unknown:
            (letters if _of_letters(w) else others).append(w)
        for at in range(0, len(letters), 5000):
            some = letters[at:at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            if len(ends) != len(some):  # a letter that is lowered or composed to a letter and a mark ends its run: every word has one run or more
                others += some
                continue
            data = ids.tobytes()
            self.known.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)]))
        for word, e in zip(others, self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)):
            self.known[word] = np.array(e.ids, dtype="<u4").tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, those that are not known learnt first."""
        if len(self.known) > self.KEPT:
            self.known.clear()
        known, stops = self.known, self.STOPS
        found = list(map(known.get, words))
        if None in found:
            new = {w for w, f in zip(words, found) if f is None}
            parted = [(w, f) for w in new if w and w[-1] in stops and (f := w.rstrip(stops)) and (f[-1:].isalnum() or _of_letters(f)) and b"<|" not in w]
            new.difference_update(w for w, _ in parted)
            new.update(f for _, f in parted)
            new.update(w[len(f):] for w, f in parted)
            self._learn(list(new.difference(known)))
            for word, front in parted:
                known[word] = known[front] + known[word[len(front):]]
            found = [known[w] if f is None else f for w, f in zip(words, found)]
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint32 ids of each text; null counts as empty. Different words are told apart in Arrow and looked up once for all the texts."""
        texts = pc.fill_null(texts, "")
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), self.ENDS, r"\1 \2")
        plain = pc.if_else(pc.match_substring(texts, "<|"), texts, parted)  # special tokens are told apart by case
        split = pc.ascii_split_whitespace(plain)  # an empty word before or behind blanks has no ids
        coded = split.flatten().dictionary_encode()
        found = self._ids(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        word = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, starts, sizes = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes, sizes[word]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = pool[np.repeat(starts[word] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[np.r_[0, np.cumsum(split.value_lengths().to_numpy())]].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, ordinary_specials: bool = False) -> WordEncoder:
    """One encoder for each Python worker: its memory of words outlives a task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _ENCODERS.setdefault((path, ordinary_specials), None) or _new(path, ordinary_specials)


def _new(path: str, ordinary_specials: bool) -> WordEncoder:
    _ENCODERS[path, ordinary_specials] = WordEncoder(path, ordinary_specials)
    return _ENCODERS[path, ordinary_specials]


def encoded(batch: pa.RecordBatch, column: int, path: str, ordinary_specials: bool = False) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batch in slices of about SLICE bytes of text, each with the ids of its texts: what a task holds at a time is a slice's."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    number = np.cumsum(sizes, dtype=np.int64) // SLICE
    bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if part := batch.slice(a, b - a):
            yield part, encoder(path, ordinary_specials).encode(part.column(column))
