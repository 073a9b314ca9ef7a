"""Token ids of whole texts by a public tokenizer file, in Arrow batches."""

from __future__ import annotations

import os
import sys
import types
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Marks that end a run after letters and that no contraction contains.
_MARKS = ".,;:!?|#$%&*"


class Encoder:
    """Encodes batches of texts without special tokens.

    by_word: for tokenizers that lower-case, drop white space and never join across it; each distinct
    run of other characters is encoded once and its ids are reused, the ids being those of the whole text.
    """

    #: Distinct runs to remember; past that, the memory starts anew.
    MOST_KNOWN = 600_000

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.by_word, self.known = Tokenizer.from_file(path), by_word, {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str, by_word: bool = True) -> Encoder:
        """One encoder for each Python process, whatever tasks it runs."""
        held = sys.modules.setdefault("_encoders_of_this_process", types.ModuleType("_encoders_of_this_process"))
        if (path, by_word) not in held.__dict__:
            held.__dict__[path, by_word] = cls(path, by_word)
        return held.__dict__[path, by_word]

    def _each(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 256):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: many are encoded as one text, which a word's last token divides."""
        out, parts = [], [words[k : k + 128] for k in range(0, len(words), 128)]
        for k in range(0, len(parts), 16):
            some = parts[k : k + 16]
            for part, encoding in zip(some, self.tokenizer.encode_batch_fast([" ".join(p) for p in some], add_special_tokens=False)):
                ids = np.array(encoding.ids, np.uint32)
                at = np.flatnonzero(self.ends[ids]) + 1
                if len(at) == len(part) and at[-1] == len(ids):
                    data, at = ids.tobytes(), (4 * at).tolist()
                    out += [data[a:b] for a, b in zip([0, *at], at)]
                else:  # a word became several, as with letters that lower-case to more than one character
                    out += self._each(part)
        return out

    def _learn(self, runs: list[str]) -> None:
        known, words, others, split = self.known, {}, [], []
        for run in runs:
            if run.isalpha():
                words[run] = None
                continue
            core = run.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha()):
                split.append((run, core, run[len(core) :]))
                if core not in known:
                    words[core] = None
            else:
                others.append(run)
        marks = list({marks for _, _, marks in split if marks not in known} - set(others))
        known.update(zip(words, self._letters(list(words))))
        known.update(zip(others + marks, self._each(others + marks)))
        known.update((run, known[core] + known[marks]) for run, core, marks in split)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and how many each text has; a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            each = self._each(texts.to_pylist())
            return np.frombuffer(b"".join(each), np.uint32), np.array([len(x) // 4 for x in each], np.int64)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else it may be a special token, whose case counts
            texts = pc.ascii_lower(texts)
        runs = pc.ascii_split_whitespace(texts)
        per_text = np.asarray(pc.list_value_length(runs), np.int64)
        coded = pc.dictionary_encode(runs.flatten())
        distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        if len(self.known) > self.MOST_KNOWN:
            self.known = {"": b""}
        ids = list(map(self.known.get, distinct))
        if fresh := [k for k, found in enumerate(ids) if found is None]:
            self._learn([distinct[k] for k in fresh])
            for k in fresh:
                ids[k] = self.known[distinct[k]]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(lengths, dtype=np.int64) - lengths
        taken = lengths[codes]
        ends = np.cumsum(taken, dtype=np.int64)
        at = np.repeat(starts[codes] - (ends - taken), taken)
        at += np.arange(len(at))
        text_ends = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return pool[at], np.diff(text_ends, prepend=0)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
