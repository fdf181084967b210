"""Token ids by the ``tokenizers`` library, encoded on the executors."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

from gristmill.llm.common import trim, turn_to

#: Bytes of words a worker remembers, in each of two generations.
CACHE_BYTES = 45_000_000
#: Characters that are encoded before the words' memory is looked at.
STEP = 1_000_000
#: Words that the library is given at one time; what it returns of them takes about 1 kB each.
LEARNED = 10_000
#: Words the library's model takes as they are: Latin letters, and a run of ASCII marks behind them.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
# The normalizer and the pre-tokenizer for which a text's ids are those of its words.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file; never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole texts. Strings of special tokens inside a text are ordinary text.

    Where the vocabulary has the normalizer and the pre-tokenizer of ``BY_WORD``,
    which never join text across a blank or a line feed, and a mark at the end of
    each word, words are encoded once, many at a time, and remembered: the ids of
    a text are those of its words in order. ``str.split`` without arguments would
    also cut at separators that the library keeps, so blanks and line feeds alone
    cut here. A word of Latin letters is one pre-token whose normal form is its
    lower case, and a run of marks behind it is another, so these go to the
    library's model without its normalizer; other words take its whole path.

    With any other vocabulary the library encodes the whole texts.
    """

    def __init__(self, path: str, width: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        most = max(self._tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.width = width or (2 if most < 1 << 16 else 4)
        if most >= 1 << 8 * self.width:
            raise ValueError(f"ids up to {most} don't fit into {self.width} bytes")
        self._kind = f"<u{self.width}"
        spec = json.loads(self._tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self._by_word = bool(suffix) and all(spec[k] == v for k, v in BY_WORD.items())
        if not self._by_word:
            return
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._spelled = str.maketrans({c: spell(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self._plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self._ends = np.zeros(most + 1, bool)
        self._ends[[k for t, k in self._tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self._words: dict[str, bytes] = {"": b""}
        self._before: dict[str, bytes] = {}
        self._held = 0

    def end(self, token_id: int) -> bytes:
        """One id, in the encoder's width."""
        return int(token_id).to_bytes(self.width, "little")

    def wide(self, ids: bytes) -> bytes | np.ndarray:
        """The ids as little-endian unsigned 32-bit integers."""
        return ids if self.width == 4 else np.frombuffer(ids, self._kind).astype("<u4")

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self._kind).tobytes()

    def _remember(self, words: list[str], ids: Iterable[bytes]) -> None:
        self._words.update(zip(words, ids, strict=True))
        self._held += 2 * sum(map(len, words)) + 170 * len(words)

    def _parts(self, parts: list[str]) -> None:
        """Learns lower-cased runs of Latin letters, and runs of ASCII marks."""
        spelled = " ".join([p if p.isascii() else p.translate(self._spelled) for p in parts])
        ids = np.array(self._plain.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self._kind)
        stops = np.flatnonzero(self._ends[ids]) + 1
        if len(stops) != len(parts) or stops[-1] != len(ids):
            raise ValueError("the model does not end each word")
        raw, cut = ids.tobytes(), (stops * self.width).tolist()
        self._remember(parts, [raw[a:b] for a, b in zip([0, *cut], cut)])

    def _learn(self, words: set[str]) -> None:
        known, before = self._words, self._before
        if old := [w for w in words if w in before]:
            self._remember(old, [before[w] for w in old])
            words.difference_update(old)
        parts: dict[str, None] = {}
        plain, letters, marks, other = [], [], [], []
        for w in words:
            if w.isascii() and w.isalpha():
                low = w.lower()
                if low != w:
                    plain.append(w)
                    letters.append(low)
                    marks.append("")
                parts[low] = None
            elif m := PLAIN.fullmatch(w):
                low, mark = m[1].lower(), m[2]
                plain.append(w)
                letters.append(low)
                marks.append(mark)
                parts[low] = parts[mark] = None
            else:
                other.append(w)
        new = [w for w in parts if w not in known]
        for at in range(0, len(new), LEARNED):
            self._parts(new[at : at + LEARNED])
        for at in range(0, len(other), LEARNED):
            some = other[at : at + LEARNED]
            self._remember(some, [self._bytes(e.ids) for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        self._remember(plain, [known[a] + known[b] for a, b in zip(letters, marks, strict=True)])

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, in ``width`` bytes each; none for a null or empty text."""
        texts = [t or "" for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < STEP:
                size += len(texts[end])
                end += 1
            some, at = texts[at:end], end
            if not self._by_word:
                out += [self._bytes(e.ids) for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                continue
            cut = [t.replace("\n", " ").split(" ") for t in some]
            words: set[str] = set()
            for own in cut:
                words.update(own)
            if new := words.difference(self._words):
                self._learn(new)
            known = self._words.__getitem__
            out += [b"".join(map(known, own)) for own in cut]
            if self._held > CACHE_BYTES:
                self._before, self._words, self._held = self._words, {"": b""}, 0
                trim()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str, width: int | None = None) -> Encoder:
    """One encoder a worker, vocabulary and width; without a width the least that fits."""
    turn_to(forget)
    if (path, width or 0) not in _ENCODERS:
        _ENCODERS[path, width or 0] = Encoder(path, width)
    return _ENCODERS[path, width or 0]


def forget() -> None:
    """Drops this worker's encoders and their words."""
    _ENCODERS.clear()
