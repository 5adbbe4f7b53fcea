"""Token ids by a public tokenizer, looked up by word.

A word's ids do not depend on what stands around it: the pre-tokenizers of these vocabularies
never match across the places where texts are cut here. So each different word of a batch is
looked up once, ids of plain words are kept between batches, and a text's ids are put together
from its words'. Kept words are one Arrow array beside one array of ids, about 30 bytes a word;
when there are too many, the half used longest ago is dropped.
"""

import contextlib
import ctypes
import gc
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Spark runs a task on each core already; threads of the library would only hold memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MOST_WORDS = 200_000  # kept between batches
AT_ONCE = 1_000  # texts given to the library, whose results are large objects
# A line end, letters whose case and byte mapping need no context, then marks.
LINE = "\x00"
PLAIN = f"^(?P<line>{LINE}?)(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?#*$%&+=/~^@-]*)$"
CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """`spaced`: a word keeps the space before it; else texts are lower-cased, spaces dropped."""

    def __init__(self, path: str, spaced: bool, most_words: int = MOST_WORDS):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # Asked for once: the library copies its whole vocabulary to count it.
        self.n_ids = self.library.get_vocab_size()
        self.spaced = spaced
        self.most_words = most_words
        self.letters = byte_letters()
        self.words = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.used, self.turn = np.zeros(0, np.int32), 0

    def _mapped(self, words: list[str]) -> list[str]:
        """The words, which hold no line end, in the byte-level alphabet."""
        text = "\n".join(words)
        if text.isascii():
            return text.replace(" ", self.letters[ord(" ")]).split("\n")
        return text.encode().decode("latin-1").translate(self.letters).split(self.letters[ord("\n")])

    def _model(self, mapped: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and their number for each."""
        tokenize = self.model.tokenize
        ids, sizes = array("I"), array("i")
        for word in mapped:
            found = tokenize(word) if word else ()
            sizes.append(len(found))
            ids.extend([t.id for t in found])
        return np.frombuffer(ids, np.uint32), np.frombuffer(sizes, np.int32)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `_model`, of different pre-tokens without line ends, known ones from the cache."""
        at = pc.index_in(words, value_set=self.words)
        fresh = words.filter(at.is_null())
        if len(fresh):
            ids, sizes = self._model(self._mapped(fresh.to_pylist()))
            at = at.to_numpy(zero_copy_only=False)
            at[np.isnan(at)] = np.arange(len(self.words), len(self.words) + len(fresh))
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids = np.concatenate([self.ids, ids])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int32)])
        at = np.asarray(at, dtype=np.int64)
        self.turn += 1
        self.used[at] = self.turn
        found = self._of(at), self.sizes[at]
        if len(self.words) > self.most_words:
            stay = np.sort(np.argpartition(-self.used, self.most_words // 2)[: self.most_words // 2])
            self.ids, self.sizes = self._of(stay), self.sizes[stay]
            self.words, self.used = self.words.take(pa.array(stay)), self.used[stay]
        return found

    def _of(self, at: np.ndarray) -> np.ndarray:
        return _gather(at, np.array([0, len(at)]), self.ids, self.sizes)[0]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `_model`, by the library's own cuts."""
        ids, sizes = array("I"), array("i")
        for a in range(0, len(texts), AT_ONCE):
            for found in self.library.encode_batch_fast(
                texts[a : a + AT_ONCE], add_special_tokens=False
            ):
                sizes.append(len(found))
                ids.extend(found.ids)
        return np.frombuffer(ids, np.uint32), np.frombuffer(sizes, np.int32)

    def word_ids(self, words: pa.Array, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and their number for each word.

        `lead` stands before every word but one that begins a line.
        """
        pattern = PLAIN if self.spaced else PLAIN.replace(f"{LINE}?", "")
        plain = pc.extract_regex(words, pattern)
        line, head, marks = (plain.field(k) for k in range(3))
        if lead:
            bare = pc.or_(pc.equal(line, LINE), plain.is_null())
            head = pc.if_else(bare, head, pc.binary_join_element_wise(lead, head, ""))
        else:
            head = pc.utf8_lower(head) if not self.spaced else head
        odd = np.flatnonzero(plain.is_null().to_numpy(zero_copy_only=False))
        line = pc.fill_null(pc.equal(line, LINE), False).to_numpy(zero_copy_only=False)
        # Entries: none, a line end, then those of each column.
        breaks = self._model([self.letters[ord("\n")]] if self.spaced else [])
        pools = [breaks]
        before = 1 + len(breaks[1])
        which = np.zeros((len(words), 4), dtype=np.int64)
        which[:, 0] = line if self.spaced else 0
        for k, column in enumerate((head, marks), 1):
            column = pc.fill_null(column, "").dictionary_encode()
            pools.append(self._plain(column.dictionary))
            which[:, k] = column.indices.to_numpy().astype(np.int64) + before
            before += len(column.dictionary)
        whole = [w.as_py() for w in words.take(pa.array(odd))]
        pools.append(
            self._library(
                ["\n" + w[1:] if self.spaced and w.startswith(LINE) else lead + w for w in whole]
            )
        )
        which[odd, 3] = np.arange(before, before + len(odd))
        ids = np.concatenate([p[0] for p in pools])
        sizes = np.concatenate([[0], *[p[1] for p in pools]]).astype(np.int64)
        ends = np.arange(0, 4 * len(words) + 1, 4)
        flat, stops = _gather(which.ravel(), ends, ids, sizes)
        return flat, np.diff(stops, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text ends among them."""
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if not self.spaced:
            cut = pc.ascii_split_whitespace(texts)
            words = cut.flatten().dictionary_encode()
            starts = cut.offsets.to_numpy()
            return _gather(words.indices.to_numpy(), starts, *self.word_ids(words.dictionary))
        marked = pc.match_substring(texts, LINE).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", f" {LINE}"), " ")
        starts = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        names, which = words.dictionary, words.indices.to_numpy().astype(np.int64)
        opening, first = np.unique(which[starts[:-1]], return_inverse=True)
        which[starts[:-1]] = first + len(names)
        head_ids, head_sizes = self.word_ids(names.take(pa.array(opening)))
        ids, sizes = self.word_ids(names, " ")
        flat, ends = _gather(
            which, starts, np.concatenate([ids, head_ids]), np.concatenate([sizes, head_sizes])
        )
        # White space beside a space, which the words as cut here do not show.
        loose = pc.match_substring_regex(names, rf"^$|^{LINE}$|^{LINE}?\s|[^!-~À-ɏ]$|^{LINE}?[^!-~À-ɏ{LINE}]")
        loose = loose.to_numpy(zero_copy_only=False)
        loose = np.concatenate([loose, loose[opening]])
        unsafe = (np.add.reduceat(loose[which], starts[:-1]) > 0) | marked
        return self._again(texts, flat, ends, np.flatnonzero(unsafe))

    def _again(self, texts, flat, ends, unsafe) -> tuple[np.ndarray, np.ndarray]:
        """Put in place the ids of texts that need the library's own cuts."""
        if not len(unsafe):
            return flat, ends
        pieces = np.split(flat, ends[:-1])
        for k in unsafe.tolist():
            head, *rest = CUT.split(texts[k].as_py())
            pieces[k] = self._library([head, *[" " + w for w in rest]])[0]
        return np.concatenate(pieces), np.cumsum([len(p) for p in pieces])


def _gather(which, starts, ids, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of entry after entry, and where each run of entries ends; empty runs may occur."""
    begins = np.cumsum(sizes) - sizes
    own = sizes[which].astype(np.int64)
    ends = np.cumsum(own)
    places = np.arange(int(own.sum())) + np.repeat(begins[which] - (ends - own), own)
    return ids[places], np.concatenate([[0], ends])[starts[1:]]


TOKENIZERS: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, spaced: bool) -> WordTokenizer:
    """One for each Python worker, which serves many tasks; asked for as a task begins."""
    gc.collect()  # buffers that the worker's earlier tasks left in reference cycles
    if (path, spaced) not in TOKENIZERS:
        # Memory of the C library's pool can be given back whole; see `give_back`.
        pa.set_memory_pool(pa.system_memory_pool())
        TOKENIZERS[path, spaced] = WordTokenizer(path, spaced)
    return TOKENIZERS[path, spaced]


def parts(texts: pa.Array, most_bytes: int = 4_000_000):
    """(first, length) of runs of texts of about `most_bytes`, for bounded memory."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most_bytes
    edges = np.flatnonzero(np.diff(group, prepend=-1)) if len(texts) else []
    for a, b in zip(edges, [*edges[1:], len(texts)], strict=True):
        yield int(a), int(b - a)
        give_back()


def give_back() -> None:
    """Return freed memory to the system; Spark keeps idle Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
