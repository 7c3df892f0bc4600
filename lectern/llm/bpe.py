"""Byte-level BPE with the tokenizers library: memoised pieces, and resynchronised windows for huge texts."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np

from lectern.llm.common import MEMOS

#: Pieces remembered by one Python worker, unless asked for more, before those seen once go (about 100 MB).
MEMO_PIECES = 500_000
#: Characters of one window of a huge text, and by how much two windows overlap at first.
WINDOW_CHARS = 16_384
OVERLAP_CHARS = 512
#: Unknown pieces that one call of the library gets at once.
_JOIN = 1024
# A space between two white-space characters; the search begins at spaces, which is faster than at any white space.
_INNER = re.compile(r" (?<=\s )\s")
#: A word of letters that are letters in any version of Unicode, or of digits; marks behind it (no apostrophe, which may begin an ending like 's); the same after a line end.
_PARTS = re.compile(r"( ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+))([!-&(-/:-@\[-`{-~]+)?(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+)([!-&(-/:-@\[-`{-~]+)?)?")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Memo(dict):
    """Piece to number; a piece not seen before gets the next number and is put down as pending."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.pending.append(piece)
        return n


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array itself if it has ``n`` places, else one at least twice as long that begins with it."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """Ids exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    For a byte-level BPE without a normaliser, a space that has a non-space before or after it
    always starts a new pre-token, whatever else stands around. Such texts are cut there, each
    distinct piece is encoded by the library once, and the ids are put together again. Texts with a
    space between two white-space characters or with the string of an added token, and all texts of
    other tokenizers, go to the library whole.
    """

    def __init__(self, path: str, most: int = MEMO_PIECES) -> None:
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        plain = not any(x.get("lstrip") or x.get("rstrip") or re.search(r"\s", x["content"]) for x in spec.get("added_tokens", []))
        self.pieces = plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token.encode()) if token in self.added else len(token)
        self._forget()

    def _forget(self) -> None:
        #: Pieces between spaces; the piece at the head of a text, which no space goes before, has one put in front here.
        self.memo = _Memo()
        # Ids of all pieces one after another, where each piece begins and how many it has; the arrays have room to grow.
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        #: How often each piece was asked for, halved whenever others go.
        self.uses = np.zeros(1 << 14, np.int64)

    def _thin(self) -> None:
        """Forget the pieces asked for once, and the rarer of the others beyond half of the room."""
        uses, names = self.uses[: len(self.memo)], list(self.memo)
        often = np.flatnonzero(uses > 1)
        often = np.sort(often[np.argsort(-uses[often], kind="stable")[: self.most // 2]])
        ids, size, uses = self._take(often), self.size[often], uses[often] // 2
        self._forget()
        self.memo.update(zip([names[i] for i in often.tolist()], range(len(often)), strict=True))
        self.begin, self.size, self.uses = (_room(x, len(often)) for x in (self.begin, self.size, self.uses))
        self._keep(np.arange(len(often)), ids, size)
        self.uses[: len(often)] = uses

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def safe(self, text: str) -> bool:
        """Whether the text can be cut at its spaces."""
        return not (_INNER.search(text) or any(a in text for a in self.added))

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another, and the number of ids of each text."""
        if not self.pieces:
            out = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([*out, np.zeros(0, np.uint32)]).astype(np.uint32), np.array([len(x) for x in out], np.int64)
        if len(self.memo) > self.most:
            self._thin()
        look = self.memo.__getitem__
        numbers: list[int] = []
        ends, odd = [], {}
        for i, text in enumerate(texts):
            if self.safe(text):
                pieces = text.split(" ")
                pieces[0] = " " + pieces[0]
                numbers.extend(map(look, pieces))
            else:
                odd[i] = self.whole(text)
            ends.append(len(numbers))
        self._learn()
        at = np.array(numbers, np.int64)
        self._count(at)
        ids, upto = self._take(at), np.concatenate([[0], np.cumsum(self.size[at])])
        bounds = upto[np.array([0, *ends], np.int64)]
        counts = np.diff(bounds)
        if odd:
            parts = [odd[i] if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, counts = np.concatenate(parts).astype(np.uint32), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def _learn(self) -> None:
        """Encode the pending pieces, whose numbers end with the last one given."""
        pending = self.memo.pending
        base, look = len(self.memo) - len(pending), self.memo.__getitem__
        body, heads, alone, made, parts, counts = [], [], [], [], [], []
        # Word, marks, line end, word and marks are pre-tokens in any context, so many pieces are put together from parts
        # that others share. Parts not known yet join the list while it is gone through; they have no parts themselves.
        for i, p in enumerate(pending):
            if p.isalpha():
                body.append(i)
            elif (found := _PARTS.fullmatch(p)) and found.end(1) < len(p):
                word, marks, after, more = found.groups()
                had = len(parts)
                parts.append(look(word))
                if marks:
                    parts.append(look(" " + marks))
                if after:
                    parts += [look(" \n"), look(" " + after)]
                    if more:
                        parts.append(look(" " + more))
                made.append(i)
                counts.append(len(parts) - had)
            # One that cannot be printed may hold other white space; it is not joined with others, nor are empty ones.
            elif not p.isprintable() or p in ("", " "):
                alone.append(i)
            else:
                (heads if p[0] == " " else body).append(i)
        self.memo.pending = []
        self.begin, self.size = _room(self.begin, len(self.memo)), _room(self.size, len(self.memo))
        for these, sep in ((body, " "), (heads, "\n")):
            for j in range(0, len(these), _JOIN):
                some = these[j : j + _JOIN]
                if not self._joined(base + np.array(some), [pending[i] for i in some], sep):
                    alone += some
        for j in range(0, len(alone), _JOIN):
            some = alone[j : j + _JOIN]
            texts = [pending[i][1:] if pending[i][:1] == " " else " " + pending[i] for i in some]
            lists = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            self._keep(base + np.array(some), np.array(list(itertools.chain.from_iterable(lists)), np.uint32), np.array(list(map(len, lists)), np.int64))
        if made:
            at = np.array(parts, np.int64)
            self._count(at)
            first = np.cumsum(counts) - counts
            self._keep(base + np.array(made), self._take(at), np.add.reduceat(self.size[at], first))

    def _joined(self, at: np.ndarray, pieces: list[str], sep: str) -> bool:
        """Encode printable pieces in one text: with the spaces before them, or heads as lines; False where ids do not end with pieces.

        A line end between two characters that are no white space is a pre-token of its own, one byte and so one id.
        """
        text = " " + " ".join(pieces) if sep == " " else "\n".join([p[1:] for p in pieces])
        ids = self.whole(text)
        ends = np.cumsum(self.token_bytes[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        want = np.append(np.flatnonzero(raw == ord(sep)), len(raw))[1 if sep == " " else 0 :]
        cut = np.searchsorted(ends, want)
        if not (len(ends) and cut[-1] < len(ends) and np.array_equal(ends[cut], want)):
            return False
        sizes = np.diff(cut, prepend=-1)
        if sep != " ":
            lines = cut[:-1] + 1
            if not np.array_equal(ends[lines], want[:-1] + 1):
                return False
            ids = np.delete(ids, lines)
            sizes[1:] -= 1
        self._keep(at, ids, sizes)
        return True

    def _count(self, at: np.ndarray) -> None:
        self.uses = _room(self.uses, len(self.memo))
        self.uses[: len(self.memo)] += np.bincount(at, minlength=len(self.memo))

    def _take(self, at: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces, one after another."""
        n = self.size[at]
        upto = np.cumsum(n)
        return self.ids[np.repeat(self.begin[at] - upto + n, n) + np.arange(int(n.sum()))]

    def _keep(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = _room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def resync(self, text: str, window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
        """Ids of a huge text from overlapping windows.

        Each window is encoded with the byte offsets of its ids. Two neighbours are spliced at a
        position in their overlap that is stable in any context (a space between two non-spaces) and
        at which an id ends in both. Where there is none the overlap doubles, up to the rest of the text.
        """
        if not self.pieces:
            return self.whole(text)
        out, start, skip, n = [], 0, 0, len(text)
        while True:
            lap = max(2, overlap)
            end = min(n, start + max(window, 2 * lap))
            while True:
                ids, _ = self.encode_block([text[start:end]])
                if end == n:
                    return np.concatenate([*out, ids[skip:]]).astype(np.uint32)
                low = max(start + 1, end - lap)
                ends = np.cumsum(self.token_bytes[ids])
                splice = None
                if cut := _CUT.search(text, low + 1, end):
                    left = int(np.searchsorted(ends, len(text[start : cut.start()].encode())))
                    after, _ = self.encode_block([text[low:end]])
                    upto = np.cumsum(self.token_bytes[after])
                    right = int(np.searchsorted(upto, len(text[low : cut.start()].encode())))
                    if ends[left] == len(text[start : cut.start()].encode()) and upto[right] == len(text[low : cut.start()].encode()):
                        splice = left + 1, right + 1
                if splice:
                    break
                end, lap = min(n, end + lap), 2 * lap
            out.append(ids[skip : splice[0]])
            start, skip = low, splice[1]


@functools.lru_cache(maxsize=4)
def encoder(path: str, most: int = MEMO_PIECES) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path, most)


MEMOS[__name__] = encoder.cache_clear
