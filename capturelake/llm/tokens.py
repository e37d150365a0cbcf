"""Byte-level BPE ids of many whole texts at once, for use inside Spark tasks.

The vocabulary's splitting pattern always starts a new match at a space or line feed that stands alone between two
characters that are not white space, and after such a line feed. So texts may be cut there, the pieces encoded apart and
their ids joined. Ids of pieces seen before come from a table of bounded size that is addressed by a hash; the bytes of
every hit are compared, and a text with a piece that only shares the hash of another is encoded afresh. All other pieces are
encoded together from the rank form of the same vocabulary.

Special tokens that stand in a text are found as the tokenizer finds them (they get their own id), unless
``special_as_text``."""

from __future__ import annotations

import re

import numpy as np

TABLE_BITS = 21  # slots for known pieces; the table is emptied when half full
LONG = 1 << 21  # longer texts are encoded in runs of about so many characters, cut at a safe space
SAFE = re.compile(r"(?<=[A-Za-z,.]) (?=[A-Za-z])")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LEAD2 = np.zeros(256, bool)  # lead bytes of white space outside ASCII: such a character beside a space is left uncut
_LEAD2[0xC2] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[[0xE1, 0xE2, 0xE3]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PRIME = np.uint64(2**31 - 1)
_BYTE_P = _rng.integers(1, 2**31 - 1, 256, dtype=np.uint64)
_Q = int(_rng.integers(1 << 20, 2**31 - 1))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x == PRIME, np.uint64(0), x)


class Powers:
    """Powers of P and of 1/P modulo 2**64, and of Q and 1/Q modulo PRIME."""

    def __init__(self) -> None:
        self.of = [np.ones(1, np.uint64)] * 4

    def to(self, n: int) -> list[np.ndarray]:
        if len(self.of[0]) < n:
            m = 1 << (n - 1).bit_length()
            self.of = []
            for base in (_P, _P_INV):
                x = np.full(m, base)
                x[0] = 1
                self.of.append(np.multiply.accumulate(x))
            for q in (_Q, pow(_Q, -1, int(PRIME))):
                x, step = np.ones(1, np.uint64), q
                while len(x) < m:  # doubling: the second half is the first, times q to the half's length
                    x = np.concatenate([x, _fold(x * np.uint64(step))])
                    step = step * step % int(PRIME)
                self.of.append(x)
        return self.of


POWERS = Powers()


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans wherever they stand.

    Two polynomials, modulo 2**64 and modulo a prime, so that texts built to agree in the first (words of Thue and Morse)
    differ in the second."""
    up, down, up_p, down_p = POWERS.to(len(buf) + 1)
    total, total_p = np.zeros(len(buf) + 1, np.uint64), np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    np.cumsum(_fold(_BYTE_P[buf] * up_p[: len(buf)]), out=total_p[1:])
    second = _fold(_fold(total_p[ends] - total_p[starts]) * down_p[starts])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) + mix(second))


class TextEncoder:
    hash = staticmethod(spans_hash)

    def __init__(self, json_path: str, rank_path: str, special_as_text: bool = False):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.json_path, self.tokenizer, self.special_as_text = json_path, None, special_as_text
        with open(json_path) as f:
            added = [] if special_as_text else json.load(f)["added_tokens"]
        self.special = {x["content"]: x["id"] for x in added}
        self.plain = not any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = [len(token) for token in ranks]
        self._reset()

    def _reset(self) -> None:
        self.key, self.at = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.ids, self.used, self.starts, self.known = np.empty(1 << 16, np.uint32), 0, np.zeros(1 << 12, np.int64), 0
        self.held, self.held_at = np.empty(1 << 18, np.uint8), np.zeros(1 << 12, np.int64)  # bytes of each known piece

    def whole(self, text: str) -> np.ndarray:
        """Straight from the tokenizer: what encode() must equal."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.json_path)
            self.tokenizer.encode_special_tokens = self.special_as_text
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if unknown."""
        mask, out = np.uint64((1 << TABLE_BITS) - 1), np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(left):
            got = self.key[slot]
            hit = got == h[left]
            out[left[hit]] = self.at[slot[hit]]
            go = ~hit & (got != 0)
            left, slot = left[go], (slot[go] + 1) & int(mask)
        return out

    def _keep(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << TABLE_BITS) - 1
        left, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[left[free]]
            mine = self.key[slot] == h[left]
            self.at[slot[mine]] = number[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & mask

    def _learn(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> None:
        """Encode pieces together. One that begins with no space goes behind a line feed; odd ends are encoded alone."""
        data, first, last, all_s, all_e = buf.tobytes(), buf[s], buf[e - 1], s, e
        feed = (first == 10) & (e - s == 1)
        inner = np.where(first == 32, buf[np.minimum(s + 1, e - 1)], first)
        odd = _SPACE[inner] | _LEAD2[inner] | _LEAD3[inner] | _SPACE[last] | ((last >= 0x80) & (_LEAD2[buf[e - 2]] | _LEAD3[buf[e - 3]]))
        odd &= ~feed
        alone = [self.ranked(data[i:j].decode()) for i, j in zip(s[odd].tolist(), e[odd].tolist(), strict=True)]
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        s, e, feed, lead = s[~odd], e[~odd], feed[~odd], (first != 32)[~odd] & ~feed[~odd]
        got, begin, ends = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(s):
            led = [data[i:j] if not x else b"\n" + data[i:j] if x == 1 else b"\nx" for i, j, x in zip(s.tolist(), e.tolist(), (lead + 2 * feed).tolist(), strict=True)]
            got = np.array(self.ranked(b"".join(led).decode()), np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes[got]), np.cumsum(e - s + lead + feed), side="right")
            begin = np.concatenate([[0], ends[:-1]]) + lead
            ends = ends - feed
        length = ends - begin
        first = np.cumsum(length) - length
        ids = got[np.repeat(begin - first, length) + np.arange(length.sum())]
        extra = [np.array(x, np.uint32) for x in alone]
        ids = np.concatenate([ids, *extra])
        length = np.concatenate([length, [len(x) for x in extra]]).astype(np.int64)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        n = len(order)
        while self.known + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
            self.held_at = np.concatenate([self.held_at, np.zeros(len(self.held_at), np.int64)])
        size = (all_e - all_s)[order]
        self.held_at[self.known + 1 : self.known + n + 1] = self.held_at[self.known] + np.cumsum(size)
        begin, end = self.held_at[self.known], self.held_at[self.known + n]
        while end > len(self.held):
            self.held = np.concatenate([self.held, np.empty(len(self.held), np.uint8)])
        self.held[begin:end] = buf[_each(all_s[order], size)]
        self.starts[self.known + 1 : self.known + n + 1] = self.used + np.cumsum(length)
        number = np.arange(self.known, self.known + n, dtype=np.int32)
        self._keep(h[order], number)
        self.used += len(ids)
        self.known += n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        if self.find_special and any(map(self.find_special.search, texts)):
            return [self._special(t) if self.find_special.search(t) else self.encode([t])[0] for t in texts]
        if any(len(t) > LONG for t in texts):
            return [x for t in texts for x in (self.encode([t]) if len(t) <= LONG else [np.concatenate([self._encode([r])[0] for r in _runs(t)])])]
        return self._encode(texts)

    def _special(self, text: str) -> np.ndarray:
        """Ids of a text that holds special tokens: they are cut out first, and what is between them is encoded apart."""
        if not self.plain:
            return self.whole(text)
        parts = self.find_special.split(text)
        between = iter(self.encode(parts[::2]))
        return np.concatenate([np.array([self.special[p]], np.uint32) if i % 2 else next(between) for i, p in enumerate(parts)])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        buf = np.frombuffer(b"\n\n" + b"\n\n".join(raw) + b"\n\n\n", np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        doc = np.cumsum(size + 2) - size
        clean = ~_SPACE[buf]
        # A character before position i may end white space outside ASCII only if its lead byte says so; likewise after it.
        at = np.flatnonzero(((buf == 32) | (buf == 10))[3:-3]) + 3
        before, after = buf[at - 1], buf[at + 1]
        alone = clean[at - 1] & clean[at + 1] & ~_LEAD2[after] & ~_LEAD3[after] & ~((before >= 0x80) & (_LEAD2[buf[at - 2]] | _LEAD3[buf[at - 3]]))
        at = at[alone]
        cut = np.sort(np.concatenate([doc, at, at[buf[at] == 10] + 1]))
        cut = cut[np.concatenate([[True], cut[1:] != cut[:-1]])] if len(cut) else cut
        last = np.searchsorted(cut, doc[1:]) - 1
        ends = np.append(cut[1:], doc[-1] + size[-1])
        ends[last] = doc[:-1] + size[:-1]
        full = ends > cut
        cut, ends = cut[full], ends[full]
        h = self.hash(buf, cut, ends)
        h[h == 0] = 1
        if self.known + len(h) > 1 << (TABLE_BITS - 1):
            self._reset()
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, which = np.unique(h[new], return_index=True)
            which = new[which]
            self._learn(buf, cut[which], ends[which], fresh)
            number[new] = self._find(h[new])
        odd = np.unique(np.searchsorted(doc, cut[~self._same(buf, cut, ends, number)], side="right") - 1)
        begin, length = self.starts[number], self.starts[number + 1] - self.starts[number]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(cut, np.append(doc, len(buf)))]
        out = [ids[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for d in odd.tolist():  # a piece of it has the hash of another
            out[d] = np.array(self.ranked(raw[d].decode()), np.uint32)
        return out

    def _same(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the bytes of each piece are those of the known piece that its hash led to."""
        size = e - s
        same = size == self.held_at[number + 1] - self.held_at[number]
        which = np.flatnonzero(same)
        size = size[which]
        differ = self.held[_each(self.held_at[number[which]], size)] != buf[_each(s[which], size)]
        if differ.any():
            same[which[np.unique(np.searchsorted(np.cumsum(size), np.flatnonzero(differ), side="right"))]] = False
        return same


def _each(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as size says, one after the other."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def _runs(text: str) -> list[str]:
    out, begin = [], 0
    while len(text) - begin > LONG and (m := SAFE.search(text, begin + LONG // 2)):
        out.append(text[begin : m.start()])
        begin = m.start()
    return [*out, text[begin:]]


_encoders: dict[tuple[str, str, bool], TextEncoder] = {}


def encoder(json_path: str | None = None, rank_path: str | None = None, special_as_text: bool = False) -> TextEncoder:
    """One for each Python worker. The two paths must hold the same vocabulary."""
    if json_path is None or rank_path is None:
        import public_tokenizers

        json_path, rank_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    key = (json_path, rank_path, special_as_text)
    if key not in _encoders:
        _encoders[key] = TextEncoder(*key)
    return _encoders[key]
