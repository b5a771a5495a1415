"""Whole texts to ids with the tokenizers library, each distinct word once in a while.

Byte-level pre-tokenizers of the GPT-2 kind never let a piece run past the character before white space.  So a text
without two white space characters in a row can be cut before each space and at each line feed, and its ids are
those of the words in turn.  Arrow cuts the texts of a batch and finds their distinct words; ids of words are remembered in a bounded memory.
Latin letters and the ASCII marks after them are a piece each, which the library's model takes without a search for pieces, many
of them in one call; any other word goes through the whole library.
A text that holds an added token of the tokenizer, any other text, and any other kind of tokenizer, is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered in each Python worker.
WORDS = 1_000_000
#: Pieces that the model takes in one call.
PIECES = 500
#: White space in Arrow's patterns, as Python has it.
SPACE = "[" + "".join(f"\\x{{{k:x}}}" for k in range(sys.maxunicode + 1) if chr(k).isspace()) + "]"
#: Letters, which are letters in every version of Unicode, and marks.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]))
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)).difference(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = Tokenizer(self.library.model), byte_letters()
        form = json.loads(self.library.to_str())
        pre = form["pre_tokenizer"] or {}
        self.by_word = not form["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_word = self.by_word and not form["truncation"] and not form["padding"]
        added = [t["content"] for t in form["added_tokens"] or ()]
        self.by_word = self.by_word and not any(re.search(r"\s", t) for t in added)
        self.odd = "|".join([r"\A\z", rf"\A{SPACE}", rf"{SPACE}\z", f"{SPACE}{SPACE}", *map(re.escape, added)])
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.feed = self.whole("\n")
        self.by_word = self.by_word and len(self.feed) == np.dtype(self.kind).itemsize
        model = form["model"]
        self.in_turn = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "ignore_merges"))
        starts, feed = self.letters[ord(" ")], self.letters[ord("\n")]
        vocab = self.library.get_vocab()
        #: ids that begin a piece after a space, or after a line feed
        self.begins = np.zeros((2, max(vocab.values(), default=0) + 1), dtype=bool)
        self.begins[0, [k for t, k in vocab.items() if t[0:1] == starts]] = True
        self.begins[1, [k for t, k in vocab.items() if t == feed]] = True
        #: packed ids by word (marks after letters are left out): a line feed and the word at the start of a line or text, else the word, which a space goes before
        self.memory: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype=self.kind).tobytes()

    def model_ids(self, text: str) -> np.ndarray:
        """Ids by the model alone: nothing is cut, nothing added."""
        (found,) = self.model.encode_batch_fast([text.encode().decode("latin-1").translate(self.letters)], add_special_tokens=False)
        return np.array(found.ids, dtype=self.kind)

    def pieces(self, keys: list[str], line: bool) -> list[bytes]:
        """Packed ids of letters; all follow a line feed, which is in the keys, or all a space, which is not.

        Merges that stay within pieces are those of each piece alone.  A merge over the end of a piece would hide the space or line feed
        of the next one inside an id, so these are counted; if one is hidden, pieces go to the model one by one.
        """
        out = []
        for start in range(0, len(keys), PIECES):
            part = keys[start : start + PIECES]
            if self.in_turn:
                ids = self.model_ids("".join(part) if line else " " + " ".join(part))
                places = np.flatnonzero(self.begins[int(line)][ids])
                if len(places) == len(part):
                    packed, ends = ids.tobytes(), [*(places * ids.itemsize).tolist(), ids.nbytes]
                    out += [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                    continue
            out += [self.feed + self.model_ids(k[1:]).tobytes() if line else self.model_ids(" " + k).tobytes() for k in part]
        return out

    def other_words(self, keys: list[str]) -> list[bytes]:
        return [self.feed + self.whole(k[1:]) if k[0] == "\n" else self.whole(" " + k) for k in keys]

    def of_words(self, words: pa.Array) -> pa.Array:
        """Packed ids of distinct words: of letters, or of any other word, then of the marks after letters."""
        head, tail = pc.ascii_rtrim(words, MARKS), pc.utf8_ltrim(words, "\n" + LETTERS)
        latin = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(words))
        latin = pc.and_(latin, pc.invert(pc.is_in(head, pa.array(["", "\n"]))))
        head, tail = pc.if_else(latin, head, words).dictionary_encode(), pc.if_else(latin, tail, "").dictionary_encode()
        keys = head.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memory.get, keys))
        missing = np.array([k for k, found in enumerate(ids) if found is None], dtype=np.int64)
        new = head.dictionary.take(pa.array(missing))
        latin = pc.equal(pc.utf8_ltrim(new, "\n" + LETTERS), "").to_numpy(zero_copy_only=False)
        line = pc.starts_with(new, "\n").to_numpy(zero_copy_only=False)
        for which, learn in ((latin & ~line, lambda x: self.pieces(x, False)), (latin & line, lambda x: self.pieces(x, True)), (~latin, self.other_words)):
            places = missing[which].tolist()
            part = [keys[k] for k in places]
            found = learn(part)
            self.memory.update(zip(part, found, strict=True))
            for k, x in zip(places, found, strict=True):
                ids[k] = x
        marks = [self.whole(t) if t else b"" for t in tail.dictionary.to_pylist()]
        return pc.binary_join_element_wise(pa.array(ids, pa.binary()).take(head.indices), pa.array(marks, pa.binary()).take(tail.indices), pa.scalar(b"", pa.binary()))

    def by_words(self, texts: pa.Array) -> pa.Array:
        """Packed ids of texts that can be cut into words."""
        lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(lines, " ")
        coded = words.values.dictionary_encode()
        if len(self.memory) > WORDS:
            self.memory.clear()
        ids = self.of_words(coded.dictionary).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[words.offsets.to_numpy()]
        size = len(self.feed)
        # each text was taken for a line: the first id goes
        flat = np.delete(np.frombuffer(data, dtype=self.kind, count=ends[-1] // size), ends[:-1] // size)
        ends = ends - np.arange(len(ends), dtype=np.int32) * np.int32(size)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text, as Arrow's binary values; null is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd) if self.by_word else pa.array([True] * len(texts), pa.bool_())
        others = pa.array([self.whole(t) if t else b"" for t in texts.filter(odd).to_pylist()], pa.binary())
        if len(others) == len(texts):
            return others
        if not len(others):
            return self.by_words(texts)
        order = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([self.by_words(texts.filter(pc.invert(odd))), others]).take(pa.array(order))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
