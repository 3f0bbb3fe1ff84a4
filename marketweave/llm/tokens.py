"""Whole-text encoding by a public tokenizer that drops white space, with a bounded memory of chunks."""

from __future__ import annotations

import array
import gc
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain
from string import punctuation

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from marketweave.llm.common import worker_state

#: The vocabulary file that is meant where none is named.
VOCABULARY = "word_bpe_49k.json"

#: Bytes of chunks and words remembered by one worker process, about, and the longest chunk that is; others are encoded again.
REMEMBERED, LONGEST = 200_000_000, 64
#: Bytes of text split at once, and unseen words or chunks encoded at once.
AT_ONCE, ENCODED_AT_ONCE = 1_000_000, 20_000
#: What Python keeps for an entry of a dictionary beside the characters, about.
ENTRY = 170
#: Below this every letter is composed and has one lower-case letter.
PLAIN = "\u0130"


class ChunkEncoder:
    """Ids, and code point offsets, of texts, made from chunks between ASCII white space.

    The vocabulary's normaliser turns white space into one space and its splitter drops it, and no
    merge crosses it, so a text's ids are those of its chunks in order: encoding chunk by chunk equals
    encoding the whole text, and a chunk that comes again costs a lookup. A chunk of letters that the
    normaliser only lower-cases, with or without ASCII punctuation after it, is at most two words to the splitter: the
    letters go to the merges directly and the few endings are encoded once a portion.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.spans: dict[bytes, bytes] = {}
        self.word_spans: dict[str, bytes] = {}
        self.held = 0  # bytes of the four, about

    @staticmethod
    def _word(chunk: str) -> str | None:
        word = chunk.rstrip(punctuation)
        if word.isalpha() and len(chunk) <= LONGEST:
            if word.isascii() or max(word) < PLAIN:
                return word.lower()
            if word.islower() and unicodedata.is_normalized("NFC", word):
                return word
        return None

    def _learn(self, new: list[bytes], of, of_words, words: dict[str, bytes]) -> dict[bytes, bytes]:
        """What of(tokenizer, texts) gives for unseen chunks, by words where it can."""
        texts = [c.decode("utf-8", "surrogatepass") for c in new]
        parts = list(map(self._word, texts))
        unseen = list(set(parts).difference(words, (None,)))
        words.update(zip(unseen, _in_turn(of_words, self.merges, unseen), strict=True))
        self.held += ENTRY * len(unseen) + 2 * sum(map(len, unseen))
        marks = list({t[len(w) :] for t, w in zip(texts, parts, strict=True) if w is not None})
        marks = dict(zip(marks, of(self.tokenizer, marks), strict=True))
        other = _in_turn(of, self.tokenizer, [t for t, w in zip(texts, parts, strict=True) if w is None])
        got = {}
        for c, t, w in zip(new, texts, parts, strict=True):
            if w is None:
                got[c] = next(other)
            elif len(t) == len(w):
                got[c] = words[w]
            elif of is _ids:
                got[c] = words[w] + marks[t[len(w) :]]
            else:
                got[c] = words[w] + (np.frombuffer(marks[t[len(w) :]], np.int32) + np.int32(len(w))).tobytes()
        return got

    def _known(self, split: list[list[bytes]], known: dict[bytes, bytes], of, of_words, words: dict[str, bytes]) -> list[list[bytes]]:
        if self.held > self.remembered:
            known.clear(), words.clear()
            self.held = 0
        new = list(set(chain.from_iterable(split)).difference(known))
        known.update(self._learn(new, of, of_words, words))
        out = [list(map(known.__getitem__, chunks)) for chunks in split]
        for c in new:
            if len(c) > LONGEST:
                del known[c]
            else:
                self.held += ENTRY + 2 * len(c)
        return out

    def ids_of(self, raws: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text in UTF-8."""
        out: list[bytes] = []
        gc.disable()  # it would visit every remembered chunk again and again
        try:
            for part in _portions(raws):
                out += [b"".join(x) for x in self._known([raw.split() for raw in part], self.chunks, _ids, _word_ids, self.words)]
        finally:
            gc.enable()
        return out

    def spans_of(self, raws: list[bytes]) -> list[np.ndarray]:
        """First and end code points of each token, shape (tokens, 2), of each text in UTF-8."""
        return [spans for part in _portions(raws) for spans in self._spans_of(part)]

    def _spans_of(self, raws: list[bytes]) -> list[np.ndarray]:
        out = []
        for raw, parts in zip(raws, self._known([raw.split() for raw in raws], self.spans, _offsets, _offsets, self.word_spans), strict=True):
            own = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2).astype(np.int64)
            if parts:
                data = np.frombuffer(raw, np.uint8)
                blank = (data == 32) | ((data >= 9) & (data <= 13))
                begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
                if not raw.isascii():
                    begins = (np.cumsum((data & 0xC0) != 0x80) - 1)[begins]
                own = own + np.repeat(begins, np.fromiter(map(len, parts), np.int64, len(parts)) // 8)[:, None]
            out.append(own)
        return out


def _portions(raws: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in turn, about AT_ONCE bytes together, so that few of their chunks are held at a time."""
    part, size = [], 0
    for raw in raws:
        part.append(raw)
        size += len(raw)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _in_turn(of, tokenizer: Tokenizer, texts: list[str]) -> Iterator[bytes]:
    """What of(tokenizer, texts) gives, some texts at a time: encodings are many times as large as what is kept of them."""
    for at in range(0, len(texts), ENCODED_AT_ONCE):
        yield from of(tokenizer, texts[at : at + ENCODED_AT_ONCE])


def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
    return [array.array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _word_ids(merges: Tokenizer, words: list[str]) -> list[bytes]:
    """_ids of words of letters, many in one encoding with commas between them; no word has a comma's token."""
    (comma,), out = merges.encode(",").ids, []
    for e in merges.encode_batch_fast([" , ".join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False):
        ids = np.array(e.ids, "<u4")
        ends, data = [*(4 * np.flatnonzero(ids == comma)).tolist(), 4 * len(ids)], ids.tobytes()
        out += [data[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]
    return out


def _offsets(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
    return [array.array("i", [x for o in e.offsets for x in o]).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encoder(path: str | None = None, remembered: int = REMEMBERED) -> ChunkEncoder:
    """One encoder a worker process, kept until another state is asked for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    path = path or public_tokenizers.path(VOCABULARY)
    return worker_state((path, remembered), lambda: ChunkEncoder(path, remembered))
