"""Subword ids of whole texts by a public tokenizer file, each distinct word encoded once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that the tokenizer's own text steps leave as they are: lower-case letters without marks.
PLAIN = "^[a-zß-öø-ÿ]+$"
#: Signs that end a run of letters and start a token of their own; no apostrophe, which may belong to the letters.
SIGNS = ".,!?;:|*#$%&"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids as the tokenizer gives them, word by word.

    The file's tokenizer never joins characters across white space, so a text's ids are those of its
    words in order. A batch is cut at ASCII white space; plain words are cut from the signs that follow
    them; each distinct part is encoded once and kept in a store of at most ``most`` parts.
    """

    def __init__(self, path: str, most: int = 200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.model = self.full.model
        self.letters = byte_letters()
        self.most = most
        self._empty()

    def _empty(self) -> None:
        """The store: parts, where the ids of each start (with the end), and the ids."""
        self.known: dict[str, int] = {"": 0}
        self.starts = np.zeros(2, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, part: str, plain: bool) -> list[int]:
        if not plain:
            return self.full.encode(part, add_special_tokens=False).ids
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(shown)]

    def _places(self, parts: list[str], plain: list[bool]) -> np.ndarray:
        """The store's number of each part; new parts are encoded and added."""
        known = self.known
        found = list(map(known.get, parts))
        sizes, fresh = [], []
        for i in [i for i, place in enumerate(found) if place is None]:
            found[i] = known[parts[i]] = len(known)
            ids = self._encoded(parts[i], plain[i])
            sizes.append(len(ids))
            fresh += ids
        if sizes:
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.array(fresh, np.uint32)])
        return np.array(found, np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids start (with the end)."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        return self.words(words.flatten().dictionary_encode(), words.offsets.to_numpy().astype(np.int64))

    def words(self, coded: pa.DictionaryArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are cut at white space already: their words, and where each text's words start."""
        stems = pc.ascii_rtrim(coded.dictionary, characters=SIGNS)
        plain = pc.match_substring_regex(stems, PLAIN)
        # What stands behind a stem; only a plain stem is cut from its word.
        cut = pc.and_(plain, pc.less(pc.binary_length(stems), pc.binary_length(coded.dictionary)))
        tails = pc.replace_substring_regex(coded.dictionary.filter(cut), PLAIN[:-1], "").dictionary_encode()
        stems = pc.if_else(plain, stems, coded.dictionary).dictionary_encode()
        plain, cut = plain.to_numpy(zero_copy_only=False), cut.to_numpy(zero_copy_only=False)
        easy = np.zeros(len(stems.dictionary), bool)
        easy[stems.indices.to_numpy()[plain]] = True
        if len(self.known) + len(stems.dictionary) + len(tails.dictionary) > self.most:
            self._empty()
        # Two parts for each word, in the order of the text; the second may be the empty one, at place 0.
        places = np.zeros((len(plain), 2), np.int64)
        places[:, 0] = self._places(stems.dictionary.to_pylist(), easy.tolist())[stems.indices.to_numpy()]
        places[cut, 1] = self._places(tails.dictionary.to_pylist(), [False] * len(tails.dictionary))[tails.indices.to_numpy()]
        # The ids of each distinct word, then those of the texts' words.
        words, ends = self._spread(self.starts[:-1], np.diff(self.starts), self.ids, places.ravel())
        found, cuts = self._spread(ends[:-1:2], np.diff(ends[::2]), words, coded.indices.to_numpy())
        return found, cuts[offsets - offsets[0]]

    @staticmethod
    def _spread(starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``parts``, one after another, and where each starts (with the end); part p has ``sizes[p]`` ids from ``starts[p]`` on."""
        sizes = sizes[parts]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # Position k of the output belongs to part p and is the (k - ends[p])-th id of that part.
        return ids[np.arange(ends[-1]) + np.repeat(starts[parts] - ends[:-1], sizes)], ends
