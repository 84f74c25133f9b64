"""Token ids of whole texts with the public tokenizer files; the file's path is a parameter."""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: Words whose ids a worker remembers; when full it begins anew.
REMEMBERED = 500_000
#: Signs that are neither letters nor digits nor take part in a composed character's base.
SIGNS = "!#$%&()*+,-./:;?@[]^_`{|}~'\""
_LOADED: dict[tuple[str, bool], WordIds] = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters(part: str) -> bool:
    """Whether the tokenizer sees letters alone: in lower case, where a letter can become one with a mark after it."""
    return part.isalpha() and (part.isascii() or part.lower().isalpha())


def _width(word: str) -> int:
    return len(word) if word.isascii() else len(unicodedata.normalize("NFC", word).lower().encode())


class WordIds:
    """Ids of texts by a tokenizer that drops white space, lower-cases, and ends each word with a marked id.

    Such a tokenizer takes the parts between blanks and line feeds one by one, and ends a word where letters or digits
    meet other signs. So a part's ids are those of its letters and of the signs after them; each is encoded once and
    remembered. The result is what the tokenizer gives for the whole text (a test holds them equal). A text of Latin-1
    characters that holds no special token is the same in lower case.
    """

    def __init__(self, path: str, plain_specials: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.width = np.zeros(len(self.ends_word), np.int64)  # bytes of text an id stands for
        for word, i in vocabulary.items():
            self.width[i] = len(word.removesuffix("</w>"))
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """Adds parts to what is known: words of letters are encoded as one text and told apart by their marked ends."""
        known, words, signs, other = self.known, [], [], []
        for p in parts:
            if _letters(p):
                words.append(p)
            else:
                core = p.rstrip(SIGNS)
                if core != p and _letters(core):
                    signs.append((p, core, p[len(core) :]))
                else:
                    other.append(p)
        if signs:
            words += {c for _, c, _ in signs if c not in known}.difference(words)
            other += {e for _, _, e in signs if e not in known}.difference(other)
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            spans = np.diff(np.append(0, np.cumsum(self.width[ids])[ends - 1])).tolist()
            if len(ends) == len(words) and spans == [_width(w) for w in words]:
                data, at = ids.tobytes(), 0
                for w, end in zip(words, (2 * ends).tolist(), strict=True):
                    known[w] = data[at:end]
                    at = end
            else:
                other += words
        if other:
            for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u2").tobytes()
        for p, c, e in signs:
            known[p] = known[c] + known[e]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        parts = text.replace("\n", " ").split(" ")
        ids = list(map(known.get, parts))
        if None in ids:
            lost = [k for k, x in enumerate(ids) if x is None]
            self._learn(list({parts[k] for k in lost}))
            for k in lost:
                ids[k] = known[parts[k]]
        return b"".join(ids)


def word_ids(path: str | None = None, plain_specials: bool = False) -> WordIds:
    """One for each worker. plain_specials: the strings of special tokens are ordinary text."""
    key = (path or default_path(), plain_specials)
    if key not in _LOADED:
        _LOADED[key] = WordIds(*key)
    return _LOADED[key]
