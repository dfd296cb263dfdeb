"""Whole texts to token ids by a file of the tokenizers library.

The library encodes each distinct piece of text once per worker; repeated pieces
come from a memo. Pieces end before a blank, around a line feed, and before a
full stop or comma that ends a word. The files' rules never join text across
such places, so the ids of a text are those of its pieces, one after another.
Where a place is not of that kind (several blanks, signs before the stop) the
text is encoded whole. Tests hold all this against the plain call.
"""

from __future__ import annotations

import os
import re
from itertools import compress

import numpy as np

#: Bytes that the memo takes, about, before it forgets rare pieces; bytes of a piece besides its letters and ids.
MEMO, PIECE = 120_000_000, 200
#: Characters of the texts that are taken at a time, and pieces that are encoded in one call.
SLAB, CALL = 1_000_000, 10_000
#: Marks before pieces: a stop or comma, a line feed, and what follows one. Texts that have them are encoded whole.
STOP, FEED, AFTER = "\x02", "\x03", "\x04"
MARKS = ("\x01", STOP, FEED, AFTER)
#: What is known of a piece. TIED is the lowest, so that it is over WORD only where that is missing.
TIED, WORD, OPEN = 1, 2, 4
#: Pieces that may share a call: no white space but a leading blank, and no mark.
_SHARES = re.compile(r" ?[^\s\x01]+").fullmatch
#: Words of letters that stay one piece, and letters, whatever a file's normalizer and pre-tokenizer do.
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch


def _byte_signs() -> str:
    """The sign that stands for each byte in byte-level files: itself where it is visible in Latin-1, else the next from U+0100 on."""
    seen = [33 <= b < 127 or 161 <= b < 173 or b > 173 for b in range(256)]
    return "".join(chr(b) if seen[b] else chr(256 + seen[:b].count(False)) for b in range(256))


_SIGNS = _byte_signs()
_BLANK, _FEED = _SIGNS[32], _SIGNS[10]


class _Memo(dict):
    """Piece to number; an unknown piece gets the next number and is noted."""

    def __init__(self, known=()):
        super().__init__(zip(known, range(len(known))))
        self.fresh: list[str] = []

    def __missing__(self, piece):
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class Encoder:
    """ids of texts; blank_leads: a blank belongs to the word that it leads (byte-level files), else it is dropped.

    memo: the bytes that known pieces may take, about. Beyond them the encoder
    forgets the pieces that it met once, and as many others as must go.
    """

    def __init__(self, path: str, blank_leads: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blank_leads, self.limit = blank_leads, memo
        # What parts pieces that are encoded in one call: one token, which no such piece has.
        self.between = "\n" if blank_leads else " \x01 "
        mark = self._plain(self.between)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        # The file's model alone, for words of letters: spelled in the signs of their bytes, they need no more.
        from tokenizers import pre_tokenizers

        self.lowers = self._plain("A").tolist() == self._plain("a").tolist()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = ["Abc", "\xe9t\xe9", "Stra\xdfe", "\xc9OL"]
        feed = self.model.encode(_FEED, add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        if self.feed is not None and any(self._words([w])[0].tolist() != self._plain(" " + w if blank_leads else w).tolist() for w in probe):
            self.feed = None
        self._start([], np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint8))

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, with marks between them, and where each word ends."""
        lead = _BLANK if self.blank_leads else ""
        text = "\n".join(words)
        text = (text.lower() if self.lowers else text).encode().decode("latin-1").translate(_SIGNS)
        ids = np.array(self.model.encode_batch_fast([lead + text.replace(_FEED, f" {_FEED} {lead}")], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.append(np.flatnonzero(ids == self.feed), len(ids))

    def _start(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray, bits: np.ndarray):
        """Know these pieces and no other."""
        self.memo, self.letters = _Memo(pieces), sum(map(len, pieces))
        n, self.used = len(pieces), len(ids)
        room = max(1 << 14, 2 * n)
        self.flat = np.empty(max(1 << 16, 2 * len(ids)), np.uint32)
        self.flat[: len(ids)] = ids
        self.start, self.length, self.met = (np.zeros(room, np.int32) for _ in range(3))
        # Bits: no blank may follow the piece (OPEN); it ends as a word does (WORD); it must follow a word (TIED).
        self.bits = np.zeros(room, np.uint8)
        self.start[:n], self.length[:n], self.bits[:n] = np.cumsum(sizes) - sizes, sizes, bits

    def _size(self) -> int:
        return PIECE * len(self.memo) + 2 * self.letters + 4 * self.used

    def _forget(self):
        n = len(self.memo)
        kept = np.flatnonzero(self.met[:n] > 1)
        if len(kept) > n // 2:
            kept = np.sort(kept[np.argsort(self.met[kept], kind="stable")[len(kept) - n // 2 :]])
        every = list(self.memo)
        self._start([every[k] for k in kept.tolist()], self.length[kept], self._gather(kept), self.bits[kept])

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of some pieces, one after another."""
        sizes = self.length[at].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1])] if len(at) else np.empty(0, np.uint32)

    def _spelled(self, piece: str) -> str:
        if piece[:1] == STOP or piece[:1] == AFTER:
            return piece[1:]
        if piece == FEED:
            return "\n"
        return " " + piece if self.blank_leads else piece

    def _learn(self):
        """Encode the pieces noted since the last call."""
        fresh, self.memo.fresh = self.memo.fresh, []
        n = len(self.memo)
        while len(self.start) < n:
            self.start, self.length, self.met, self.bits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.met, self.bits))
        self.letters += sum(map(len, fresh))
        for k in range(0, len(fresh), CALL):
            self._learn_some(fresh[k : k + CALL], n - len(fresh) + k)

    def _learn_some(self, fresh: list[str], base: int):
        """Encode some pieces, whose numbers count from base."""
        # Where blanks are dropped, a word is the same after a line feed.
        words = fresh if self.blank_leads else [p[1:] if p[:1] == AFTER else p for p in fresh]
        letters = np.fromiter((m is not None for m in map(_LETTERS, words)), bool, len(fresh))
        if self.feed is None:
            letters[:] = False
        new = letters.copy()
        if self.lowers and not self.blank_leads:
            # Words of letters whose small form is known have its ids.
            twins = np.fromiter((self.memo.get(w.lower(), -1) if m else -1 for w, m in zip(words, letters.tolist())), np.int64, len(fresh))
            at = np.flatnonzero((twins >= 0) & (twins < base))
            self.start[base + at], self.length[base + at] = self.start[twins[at]], self.length[twins[at]]
            new[at] = False
        if new.any():
            ids, ends = self._words(list(compress(words, new.tolist())))
            if not self._found(base + np.flatnonzero(new), ids, ends):
                letters[new] = False
        self.bits[base : base + len(fresh)] = WORD
        rest = np.flatnonzero(~letters).tolist()
        spelled = [self._spelled(fresh[k]) for k in rest]
        shares = [self.mark is not None and _SHARES(s) is not None for s in spelled]
        if any(shares):
            ids = self._plain(self.between.join(compress(spelled, shares)))
            if not self._found(base + np.array(list(compress(rest, shares))), ids, np.append(np.flatnonzero(ids == self.mark), len(ids))):
                shares = [False] * len(rest)
        for k, s, shared in zip(rest, spelled, shares):
            p = fresh[k]
            if not shared:
                ids = self._plain(s)
                self._found(np.array([base + k]), ids, np.array([len(ids)]))
            x = WORD if p[-1:].isalnum() else 0
            if p[:1] == STOP:
                x |= TIED
            if not x & WORD and self.blank_leads and p != FEED and (not p or p == AFTER or s[-1:].isspace()):
                x |= OPEN
            if p[:1] == AFTER and self.blank_leads and s[:1].isspace():
                x |= TIED  # after a line feed, so it never follows a word: the text is encoded whole
            self.bits[base + k] = x

    def _found(self, at: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> bool:
        """Keep the ids of the pieces at some numbers, if each has an end."""
        if len(ends) != len(at):
            return False
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.start[at], self.length[at] = self.used + starts, ends - starts
        self._store(ids)
        return True

    def _store(self, ids: np.ndarray):
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _numbers(self, text: str) -> np.ndarray | None:
        if not text or any(m in text for m in MARKS):
            return None
        for sign in ".,":
            text = text.replace(f"{sign} ", f" {STOP}{sign} ").replace(f"{sign}\n", f" {STOP}{sign}\n")
        pieces = (AFTER + text.replace("\n", f" {FEED} {AFTER}")).split(" ")
        return np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))

    def _ids(self, text: str | None, at: np.ndarray | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        # The text begins with an empty piece if it begins with a blank or stop; nothing stands before it then.
        bits = None if at is None else self.bits[at]
        if bits is None or (bits[1:-1] & OPEN).any() or ((bits[1:] & TIED) > (bits[:-1] & WORD)).any() or bits[0] & TIED:
            return self._plain(text)
        return self._gather(at)

    def encode_all(self, texts):
        """The ids (uint32) of one text after another; null is the empty text."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size >= SLAB:
                yield from self._slab(some)
                some, size = [], 0
        yield from self._slab(some)

    def _slab(self, texts):
        if self._size() > self.limit:
            self._forget()
        numbers = [self._numbers(t) if t else None for t in texts]
        self._learn()
        known = [at for at in numbers if at is not None]
        if known:
            n = len(self.memo)
            self.met[:n] += np.bincount(np.concatenate(known), minlength=n).astype(np.int32)
        for text, at in zip(texts, numbers):
            yield self._ids(text, at)

    def encode(self, text: str | None) -> np.ndarray:
        return next(iter(self.encode_all([text])))


_ENCODERS: dict = {}


def encoder(path: str, blank_leads: bool) -> Encoder:
    """The worker's encoder of a file."""
    if (path, blank_leads) not in _ENCODERS:
        _ENCODERS[path, blank_leads] = Encoder(path, blank_leads)
    return _ENCODERS[path, blank_leads]
