"""Token ids of a byte-level BPE vocabulary, fast for many texts.

The ids are those of the ``tokenizers`` library. Texts are cut into words
with array operations, each distinct word of a group is encoded once, and the
ids are put back in place. A text that the array cutter does not cover goes
through the library whole: contractions, special-token strings, and scripts
beyond the Latin, Greek, Cyrillic and Semitic blocks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

from hearth.llm.textvec import groups, points, span_hashes

CACHE_WORDS = 300_000
_SIMPLE_BELOW = 0x2E80
_CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
# The word pattern of this kind of vocabulary, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


@cache
def _kinds() -> np.ndarray:
    """1 white space, 2 letter, 3 number, 4 other."""
    out = np.full(0x110000, 4, np.uint8)
    for i in range(_SIMPLE_BELOW):
        c = unicodedata.category(chr(i))[0]
        out[i] = 2 if c == "L" else 3 if c == "N" else 4
    out[[ord(c) for c in WHITE]] = 1
    return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        pre = spec.get("pre_tokenizer") or {}
        self.simple = (spec["model"]["type"] == "BPE" and not spec.get("normalizer")
                       and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                       and pre.get("use_regex", True))
        self.specials = sorted(added)
        self._forget()
        if self.simple:
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.core = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            line = self.core.encode_ordinary("\n")
            self.line, self.simple = line[0], len(line) == 1

    def _forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null counts as empty), without special tokens."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for first, group in groups(texts):
            latin = max((int(points(t).max()) for t in ["".join(group)] if t), default=0) < _SIMPLE_BELOW
            fast = [i for i, t in enumerate(group) if self._covered(t, latin)]
            for i, ids in zip(fast, self._fast([group[i] for i in fast]), strict=True):
                out[first + i] = ids
            for i in sorted(set(range(len(group))) - set(fast)):
                out[first + i] = np.array(
                    self.whole.encode(group[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out

    def _covered(self, text: str, latin: bool) -> bool:
        return (self.simple and (latin or text.isascii() or max(text) < chr(_SIMPLE_BELOW))
                and not ("'" in text and _CONTRACTION.search(text))
                and not any(s in text for s in self.specials))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, joined, and how many each has. The words are
        encoded as one text: a line break before a word is always one id."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        blank = [i for i, w in enumerate(words) if w.isspace() or w[0] in WHITE and w[0] != " "]
        lists: dict[int, list[int]] = {i: self.core.encode_ordinary(words[i]) for i in blank}
        rest = [w for i, w in enumerate(words) if i not in lists]
        ids = np.array(self.core.encode_ordinary("\n" + "\n".join(rest)) if rest else [], dtype=np.uint32)
        marks = np.flatnonzero(ids == self.line)
        lens = np.zeros(len(words), np.int64)
        here = np.ones(len(words), bool)
        here[blank] = False
        lens[here] = np.diff(np.append(marks, len(ids))) - 1
        flat = np.delete(ids, marks)
        if blank:
            lens[blank] = [len(lists[i]) for i in blank]
            at = np.cumsum(lens) - lens
            every = np.empty(int(lens.sum()), np.uint32)
            own = np.zeros(len(every), bool)
            for i in blank:
                every[at[i]:at[i] + lens[i]] = lists[i]
                own[at[i]:at[i] + lens[i]] = True
            every[~own] = flat
            flat = every
        return flat, lens

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cps = points(joined)
        kind = _kinds()[cps]
        begin = np.empty(len(cps), bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        cut = np.zeros(len(cps) + 1, bool)
        cut[base] = True
        begin |= cut[:-1]
        # The last white space before a word goes with the word if it is a
        # blank, else it stands alone.
        last = np.flatnonzero((kind[:-1] == 1) & (kind[1:] != 1) & ~cut[1:-1])
        begin[last] = True
        begin[last[cps[last] == 32] + 1] = False
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(cps))
        uniq, where, back = np.unique(span_hashes(cps, start, end), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, uniq)
        miss = np.ones(len(uniq), bool)
        inside = spot < len(self.known)
        miss[inside] = self.known[spot[inside]] != uniq[inside]
        flat, lens = self._encoded([joined[s:e] for s, e in zip(
            start[where[miss]].tolist(), end[where[miss]].tolist(), strict=True)])
        known = np.concatenate([self.known, uniq[miss]])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, np.cumsum(lens) - lens + len(self.flat)])[order]
        self.lens = np.concatenate([self.lens, lens])[order]
        self.flat = np.concatenate([self.flat, flat])
        spot = np.searchsorted(self.known, uniq)
        at, n, flat = self.at[spot], self.lens[spot][back], self.flat
        if len(self.known) > CACHE_WORDS:
            self._forget()
        offset = np.cumsum(n) - n
        ids = flat[np.repeat(at[back] - offset, n) + np.arange(int(n.sum()))]
        edge = np.append(offset, len(ids))[np.searchsorted(start, base)]
        return [ids[edge[i]:edge[i + 1]] for i in range(len(texts))]
