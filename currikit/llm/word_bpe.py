"""A byte-pair vocabulary with word ends, read from a ``tokenizers`` JSON file.

White space always ends a word here and is dropped, so that a text can be cut
at white space and each distinct piece handled once.
"""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import regex

#: Python's str.split() also cuts at these, which are no white space to the vocabulary's patterns.
CONTROLS = regex.compile(r"[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")
#: Marks that most often end a piece.
MARKS = ".,;:!?"
#: Up to here no letter combines with others, and lower case is the same in every version.
LATIN = "\u017f"
#: Pieces longer than this are rare and not kept.
LONGEST_KEPT = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Counts and encodes the pieces of a text."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.letters = letters
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.pairs = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.data = data

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.data.decode())

    @functools.cached_property
    def byte_of(self) -> dict[str, int]:
        return {x: b for b, x in enumerate(self.letters)}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The runs between white space."""
        return [x for x in WHITE.split(text) if x] if CONTROLS.search(text) else text.split()

    def words(self, piece: str) -> list[bytes | int]:
        """The words of a piece in order; an int is the id of a special token.

        Latin is cut here. What is a letter or a digit beyond it, its lower
        case and its composed form depend on a version of Unicode, and that of
        the library counts, so its own normalizer and pre-tokenizer cut other pieces.
        """
        stem, mark = (piece[:-1], piece[-1]) if piece[-1] in MARKS else (piece, "")
        if stem.isalpha() and (stem.isascii() or max(stem) <= LATIN):  # letters and perhaps a mark, as most pieces are: the pattern would find these
            low = stem.lower()
            if low.isalpha():
                return [low.encode(), mark.encode()] if mark else [low.encode()]
        out: list[bytes | int] = []
        for part in self.specials.split(piece) if "<" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
            elif not part or max(part) <= LATIN:
                out += [w.encode() for w in self.pattern.findall(part.lower())]
            else:
                normal = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def count(self, word: bytes) -> int:
        """Number of tokens of a word: its bytes less the merges. Symbols form a linked list, pairs wait in a heap by rank, then place; pairs that no longer stand are passed over."""
        n = len(word)
        symbols = [self.first[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if found := pairs.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, merged = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            merges += 1
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((merged, symbols[k])):
                    heappush(heap, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], merged))):
                heappush(heap, (found[0], h, symbols[h], merged, found[1]))
        return n - merges

    def ids(self, word: bytes) -> list[int]:
        """A word's token ids, by the library's model."""
        return [t.id for t in self.library.model.tokenize("".join(map(self.letters.__getitem__, word)))]


@functools.lru_cache(maxsize=2)
def loaded(data: bytes) -> WordBpe:
    return WordBpe(data)


class Kept(dict):
    """A bounded memo for a worker: what is missing is computed, and all is forgotten when it is full."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size = compute, size

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value
