"""Token ids of whole texts by a public tokenizer: words of a batch by Arrow, each new word encoded once for each worker."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_table
from .words import KeyTable, keys, split_words, spread

#: Letters that stay one letter each when normalised and lower-cased (Latin, without the dotted capital I).
_LATIN = "^[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+$"
#: Marks that may stand behind a word; none of them begins a contraction.
MARKS = ".,;:!?"
#: Words a worker's table holds, about 60 bytes each.
MOST_WORDS = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable(KeyTable):
    """Word -> its token ids, which stand in one pool."""

    arrays = ("key", "uses", "start", "size")

    def _new(self, room: int) -> None:
        super()._new(room)
        self.start, self.size = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.pool, self.used = np.zeros(2 * room, np.uint32), 0

    def add(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of new, distinct names with ``size`` ids each, that stand one after the other in ``ids``."""
        rows = self.new_rows(key)
        if self.used + len(ids) > len(self.pool):
            new = np.zeros(max(self.used + len(ids), 2 * len(self.pool)), np.uint32)
            new[: self.used] = self.pool[: self.used]
            self.pool = new
        self.size[rows], self.start[rows] = size, self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return rows

    def ids(self, rows: np.ndarray) -> np.ndarray:
        return self.pool[spread(self.start[rows], self.size[rows])]

    def make_room(self, more: int) -> bool:
        rows = self.used_most(more)
        if rows is None:
            return False
        key, ids, size, uses = self.key[rows], self.ids(rows), self.size[rows], self.uses[rows]
        self._new(1024)
        rows = self.add(key, ids, size)
        self.uses[rows] = uses / 2
        return True


class WordIds:
    """Token ids of texts, word (between ASCII white space) by word.

    Holds for tokenizers that drop white space and never merge across it, as the word BPE does: then the ids
    of a text are those of its words in order. A batch is split and its words are told apart by Arrow; only
    distinct ones are looked up. New words of letters alone, with or without marks behind, are encoded by
    their letters, many at a time, and told apart by the ids that end a word. Other words are encoded each
    by itself.
    """

    def __init__(self, path: str, limit: int = MOST_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.table, self.tokenizer = WordTable(limit), Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        # for lower-case Latin letters between spaces the full normaliser and patterns do nothing
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # a tokenizer of another kind has every word encoded by itself
        probe = "thereupon überaus. Straße"
        self.joint = bool(suffix) and self._each([probe])[0].tolist() == [x for w in ("thereupon", "überaus", ".", "straße") for x in self.bare.encode(w, add_special_tokens=False).ids]

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word), every word by itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _plain(self, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, size = [np.empty(0, np.uint32)], [np.empty(0, np.int32)]
        for i in range(0, len(cores), 1000):
            part = cores.slice(i, 1000)
            x = np.array(self.bare.encode_batch_fast([" ".join(part.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.nonzero(self.ends[x])[0] + 1
            if len(ends) != len(part):
                raise ValueError("words and ends of words don't agree")
            ids.append(x)
            size.append(np.diff(ends, prepend=0).astype(np.int32))
        return np.concatenate(ids), np.concatenate(size)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words, new ones added."""
        key = keys(words)
        rows = self.table.find(key)
        if self.table.make_room(2 * int((rows < 0).sum())):  # a new word may bring its letters along
            rows = self.table.find(key)
        new = np.nonzero(rows < 0)[0]
        if len(new):
            rows[new] = self._learn(words.take(pa.array(new)), key[new])
        return rows

    def _learn(self, words: pa.Array, key: np.ndarray) -> np.ndarray:
        core = pc.ascii_rtrim(words, characters=MARKS)
        plain = _mask(pc.ascii_is_alpha(core))
        low = pc.ascii_lower(core)
        if self.joint:
            other = np.nonzero(~plain)[0]
            rest = core.take(pa.array(other))
            latin = other[_mask(pc.match_substring_regex(rest, _LATIN))]
            if len(latin):
                low = pc.replace_with_mask(low, pa.array(_where(latin, len(words))), pc.utf8_lower(core.take(pa.array(latin))))
                plain[latin] = True
        else:
            plain[:] = False
        rows = np.full(len(words), -1, np.int64)
        odd = np.nonzero(~plain)[0]
        if len(odd):
            texts = [w.decode("utf-8", "replace") for w in words.take(pa.array(odd)).cast(pa.binary()).to_pylist()]
            rows[odd] = self.table.add(key[odd], *self._each(texts))
        at = np.nonzero(plain)[0]
        if not len(at):
            return rows
        words, low, key = words.take(pa.array(at)), low.take(pa.array(at)), key[at]
        cores = low.dictionary_encode()
        core_key = keys(cores.dictionary)
        of_core = self.table.find(core_key)
        new = np.nonzero(of_core < 0)[0]
        of_core[new] = self.table.add(core_key[new], *self._plain(cores.dictionary.take(pa.array(new))))
        mine = of_core[cores.indices.to_numpy()]
        own = (self.table.key[mine] == key).all(1)  # the word is its letters, in lower case
        marked = np.nonzero(~own)[0]
        if len(marked):
            mark, which = self._marks(words.take(pa.array(marked)), low.take(pa.array(marked)))
            table, r = self.table, mine[marked]
            size = table.size[r] + np.array([len(m) for m in mark], np.int64)[which]
            ids = np.empty(int(size.sum()), np.uint32)
            first = np.cumsum(size) - size
            ids[spread(first, table.size[r])] = table.ids(r)
            behind = np.concatenate([*mark, np.empty(0, np.uint32)])
            sizes = np.array([len(m) for m in mark], np.int64)
            starts = np.cumsum(sizes) - sizes
            ids[spread(first + table.size[r], sizes[which])] = behind[spread(starts[which], sizes[which])]
            mine[marked] = table.add(key[marked], ids, size)
        rows[at] = mine
        return rows

    def _marks(self, words: pa.Array, low: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each kind of marks behind words, and which kind each word has."""
        n = pc.subtract(pc.binary_length(words), pc.binary_length(low)).to_numpy()
        kinds: dict[str, int] = {"": 0}
        which = np.zeros(len(words), np.int64)
        for k in np.unique(n[n > 0]).tolist():
            some = np.nonzero(n == k)[0]
            tail = pc.utf8_slice_codeunits(words.take(pa.array(some)), -k).dictionary_encode()
            codes = np.array([kinds.setdefault(m, len(kinds)) for m in tail.dictionary.to_pylist()])
            which[some] = codes[tail.indices.to_numpy()]
        ids, size = self._each(list(kinds))
        return np.split(ids, np.cumsum(size)[:-1]), which

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]; null has none."""
        words, which, bounds = split_words(texts, lower=False)
        rows = self._rows(words)
        self.table.uses[rows] += np.bincount(which, minlength=len(rows)).astype(np.float32)
        size = self.table.size[rows].astype(np.int64)[which]
        ids = self.table.pool[spread(self.table.start[rows][which], size)]
        return ids, np.append(0, np.cumsum(size))[bounds]


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _where(at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def shared_ids(path: str) -> WordIds:
    """One table for each Python worker, kept from task to task."""
    return worker_table(("ids", path), lambda: WordIds(path))
