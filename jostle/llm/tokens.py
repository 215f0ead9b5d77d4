"""Token ids of whole texts by a tokenizer file, with the ids of frequent words kept."""

from __future__ import annotations

import numpy as np

#: Words that are encoded in one call.
CALL_WORDS = 500
#: Words whose ids a Python worker keeps in each of two generations, about 200 bytes each.
CACHE_WORDS = 200_000
#: Signs that end words. A run of them after a letter is a word of its own to the tokenizer.
SIGNS = '!"#$%&()*+,-./:;<=>?@[]^_`{|}~'
#: Fixed value: a special token of the vocabulary file that stands between words in such a call.
BETWEEN = "<|startoftext|>"


#: Words on which the shorter way to the ids of a plain word is tried before it is used.
PROBE = ("hello", "été", "straße", "reingwh", "ciónlljaí", "x")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the
    others for the letters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Encodes texts word by word for tokenizers that cut at white space and drop it.

    The ids of a text are then those of its words in a row; frequent words are encoded once. Texts are cut
    only at blanks, tabs and line ends, which every such tokenizer treats as white space. A word of ASCII or
    Latin letters (lower-cased, as the tokenizer does) with signs at its end is looked up as these two, and its
    letters are given to the merges directly. ``pack`` gives texts' ids as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        if self.between is None:
            raise ValueError(f"the vocabulary has no {BETWEEN}")
        self.limit = limit
        self.letters = _byte_letters()
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}  # as in the texts, and those of the generation before
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # words without signs, and signs
        self.older_parts: dict[str, bytes] = {}
        self.direct = all(self._merged(w) == self._whole(w) for w in PROBE)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.coded[t.id] for t in self.tokenizer.model.tokenize(spelled)])

    def _learn(self, words: list[str]) -> None:
        """Encode parts that no generation holds by the whole tokenizer."""
        for at in range(0, len(words), CALL_WORDS):
            part = words[at : at + CALL_WORDS]
            ids = np.array(self.tokenizer.encode(BETWEEN.join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.nonzero(ids == self.between)[0]
            raw = ids.tobytes()
            starts, ends = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(raw)]
            for word, a, b in zip(part, starts, ends, strict=True):
                self.parts[word] = raw[a:b]

    def _lacks(self, part: str) -> bool:
        """Whether neither generation holds a part; one of the older generation moves to the newer."""
        value = self.older_parts.get(part)
        if value is not None:
            self.parts[part] = value
        return value is None

    def _fill(self, new: set[str]) -> None:
        # Beyond Latin-1, lower-casing may depend on context or compose; such words are encoded as they are.
        words, older, parts, lacks = self.words, self.older, self.parts, self._lacks
        whole, wholes, split, lowers, tails = [], [], [], [], []  # columns: words and their only part, words and their two parts
        stems, others = set(), set()
        for word in new:
            if word in older:
                words[word] = older[word]
                continue
            stem = word.rstrip(SIGNS)
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                lower = stem.lower()
                if lower not in parts and lacks(lower):
                    stems.add(lower)
                if len(stem) == len(word):
                    whole.append(word)
                    wholes.append(lower)
                    continue
                signs = word[len(stem) :]
                split.append(word)
                lowers.append(lower)
                tails.append(signs)
                if signs not in parts and lacks(signs):
                    others.add(signs)
            else:
                whole.append(word)
                wholes.append(word)
                if word not in parts and lacks(word):
                    others.add(word)
        if self.direct:
            for stem in stems:
                parts[stem] = self._merged(stem)
        else:
            others |= stems
        self._learn([p for p in others if BETWEEN not in p])
        for part in others:
            if BETWEEN in part:
                parts[part] = self._whole(part)
        words.update(zip(whole, map(parts.__getitem__, wholes), strict=True))
        for word, lower, signs in zip(split, lowers, tails, strict=True):
            words[word] = parts[lower] + parts[signs]

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. New words are sought in all of them together."""
        if len(self.words) > self.limit:
            self.older, self.words = self.words, {}
        if len(self.parts) > self.limit:
            self.older_parts, self.parts = self.parts, {}
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        self._fill(new.difference(self.words))
        known = self.words
        return [b"".join(map(known.__getitem__, words)) for words in split]
