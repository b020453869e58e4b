"""SentencePiece encoding and decoding in batched numpy.

Model files are read by a small protobuf reader (pieces, scores, kinds, trainer and normaliser settings); identity
normalisation with escaped spaces is supported, others raise. Texts are cut where no piece can reach across (before a
run of spaces, around characters that no piece holds), so each distinct word is encoded once per batch.

Viterbi: words of equal length advance together; the hash of every substring is taken from prefix hashes, probed in
the sorted hashes of the pieces, and vectorised maxima keep score and backpointer of each position. In unigram models a
path's score is the sum of its pieces' scores.

BPE models: their ids follow from merge order, which the best sum of scores does not give (README has figures), but a
Viterbi path does: a sequence of pieces is what merging gives if and only if that holds for each two neighbours, and of
the pieces that end at a position just one fits the piece before it. So a transition scores its length if merging would
leave the two pieces side by side, and nothing else; the maximum is the one that fits. Whether two pieces fit is told by
undoing their merges, latest first, and looking for a merge across their border that would have come sooner; answers
are kept in a table of fixed size. `merge` runs the merge loop itself; tests hold the path, the loop and the library
against each other. Words over LONG characters are cut between characters that no piece holds side by side; what is
still longer advances alone, by the same rule.

Defined results. Null text: null ids in `encode`; empty text: no ids. Unknown characters become byte pieces if the
model has them, else the unknown id. Round trips are exact but for U+2581, which decodes as a space. Texts are
encoded whole; repeated rows give equal ids; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.base import map_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
LONG = 48
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words, and of their ids, that a task keeps from one batch to the next.
CACHE_BYTES = 16 << 20
#: Entries of the table of pairs of pieces that fit or don't.
FITS = 1 << 18
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, floats and bytes."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[i]
            n |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return n, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 5:
            value, i = struct.unpack_from("<f", data, i)[0], i + 4
        elif kind == 1:
            value, i = struct.unpack_from("<d", data, i)[0], i + 8
        else:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    def __init__(self, data: bytes) -> None:
        self.pieces, self.scores, self.kinds = [], [], []
        self.model_type, self.byte_fallback, norm = UNIGRAM, False, {}
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in fields(value):
                    piece, score, kind = (v.decode(), score, kind) if k == 1 else (piece, v, kind) if k == 2 else (piece, score, v) if k == 3 else (piece, score, kind)
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                got = dict(fields(value))
                self.model_type, self.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                norm = dict(fields(value))
        if norm.get(2) or self.model_type not in (UNIGRAM, BPE) or not norm.get(5, 1):
            raise ValueError("only unigram and BPE models with identity normalisation and escaped spaces are supported")
        self.dummy_prefix, self.trim = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        usable = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER, UNUSED)]
        if self.model_type == UNIGRAM:
            usable = [(p, i) for p, i in usable if self.kinds[i] != UNUSED]
        self.ids = dict(usable)
        self.longest = max((len(p) for p, _ in usable), default=1)
        hashes = np.zeros(len(self.pieces), np.uint64)
        self.sizes: dict[int, np.ndarray] = {}  # pieces by length
        for p, i in self.ids.items():
            self.sizes.setdefault(len(p), []).append(i)
        for n, same in self.sizes.items():
            self.sizes[n] = np.array(same)
            for x in self.points(self.sizes[n], n).T:
                hashes[same] = mix(hashes[same], x.astype(np.uint64) + np.uint64(1))
        own = np.array(sorted(self.ids.values()))
        order = own[np.argsort(hashes[own], kind="stable")]
        self.keys, self.key_ids = hashes[order], order.astype(np.int32)
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a hash")
        self.spread()
        low = min((self.scores[i] for _, i in usable), default=0.0)
        self.score = np.array(self.scores, np.float64)
        self.unknown_score = low - 10.0
        # BPE: a rank per piece, best score first
        order = np.argsort(-self.score, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.pairs = {c for p in self.ids for c in zip(p, p[1:])}
        if self.model_type == BPE:
            self.learn_merges()
        inside = any(META in p.lstrip(META) for p in self.ids)
        known = set("".join(self.ids))
        loose = "".join(c for c in "\n\t\r" if c not in known)
        loose = re.escape(loose)
        self.cut = None if inside else re.compile(f"{META}*[^{META}{loose}]+|{META}+" + (f"|[{loose}]" if loose else ""))
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(META, " ").encode("utf-8", "replace") for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("places", "flat", "begin", "held", "fit_keys", "fit_values", "starts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.spread()
        self.forget()

    def spread(self) -> None:
        """The place of the keys that share a hash's top 20 bits, for probes; and the table of pairs, empty."""
        self.starts = np.append(np.searchsorted(self.keys, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)), len(self.keys)).astype(np.int32)
        self.span = int(np.diff(self.starts).max(initial=1))
        self.fit_keys, self.fit_values = np.full(FITS, -1, np.int64), np.zeros(FITS, bool)

    def forget(self) -> None:
        """Drop the words met so far."""
        self.places: dict[str, int] = {}
        self.flat, self.begin, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def points(self, which: np.ndarray, n: int) -> np.ndarray:
        """Code points of pieces of n characters, one row each."""
        return np.frombuffer("".join(self.pieces[i] for i in which).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(which), n)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of the hashes, -1 where there is none."""
        out = np.full(h.size, -1, np.int32)
        h = h.ravel()
        bucket = (h >> np.uint64(44)).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        left = np.flatnonzero(at < stop)
        for _ in range(self.span):
            i = at[left]
            hit = self.keys[i] == h[left]
            out[left[hit]] = self.key_ids[i[hit]]
            at[left] += 1
            left = left[~hit & (i + 1 < stop[left])]
        return out

    def words(self, text: str) -> list[str]:
        """Pieces of the normalised text between which no piece reaches."""
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = (" " if self.dummy_prefix else "") + text
        text = text.replace(" ", META)
        return [text] if self.cut is None else self.cut.findall(text)

    # -- encoding of distinct words

    def encode_words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words, by length, their ids one after the other, and how many each has."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(min(len(w), LONG + 1), []).append(w)
        order, flats, counts = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for n, same in by_length.items():
            order += same
            if n > LONG:
                found = [self.long_word(w) for w in same]
                flats += found
                counts.append(np.array([len(x) for x in found], np.int64))
                continue
            step = max(64, 160_000 // n)  # bounds the table of substrings
            for lo in range(0, len(same), step):
                flat, count = self.same_length(same[lo : lo + step], n)
                flats.append(flat)
                counts.append(count)
        return order, np.concatenate(flats), np.concatenate(counts)

    def long_word(self, word: str) -> np.ndarray:
        """A long word, in parts between which no piece reaches."""
        stops = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.pairs]
        parts = [word[i:j] for i, j in zip([0, *stops], [*stops, len(word)], strict=True)]
        short = list(dict.fromkeys(p for p in parts if len(p) <= LONG))
        order, flat, counts = self.encode_words(short) if short else ([], np.zeros(0, np.int32), np.zeros(0, np.int64))
        stop = np.cumsum(counts)
        known = {p: flat[e - n : e] for p, e, n in zip(order, stop.tolist(), counts.tolist(), strict=True)}
        found = [known[p] if len(p) <= LONG else np.array(self.alone(p), np.int32) for p in parts]
        if not self.byte_fallback:  # neighbouring unknown characters are one unknown piece
            found = [x for i, x in enumerate(found) if not (i and len(x) == 1 and x[0] == self.unknown and len(found[i - 1]) and found[i - 1][-1] == self.unknown)]
        return np.concatenate(found)

    def table(self, cps: np.ndarray) -> np.ndarray:
        """[word, start, length - 1] -> piece id or -1, for words as rows of code points."""
        m, n = cps.shape
        width = min(n, self.longest)
        ids = np.full((m, n, width), -1, np.int32)
        h = np.zeros((m, n), np.uint64)
        x = cps.astype(np.uint64) + np.uint64(1)
        for k in range(width):  # hashes of all substrings of k + 1 characters from those of k
            h = mix(h[:, : n - k], x[:, k:])
            ids[:, : n - k, k] = self.probe(h).reshape(m, n - k)
        return ids

    def same_length(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        cps = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        ids = self.table(cps)
        ends = self.viterbi(ids)
        # ends[w, i]: the exclusive end of the symbol that starts at i, 0 where none starts
        w, start = np.nonzero(ends)
        length = ends[w, start] - start
        found = np.where(length <= ids.shape[2], ids[w, start, np.minimum(length, ids.shape[2]) - 1], -1)
        lost = np.flatnonzero(found < 0)
        counts = np.bincount(w, minlength=len(words))
        if len(lost):
            parts, last = [], 0
            for i in lost.tolist():
                more = self.unknown_ids(words[w[i]][start[i] : start[i] + length[i]])
                parts += [found[last:i], np.array(more, np.int32)]
                counts[w[i]] += len(more) - 1
                last = i + 1
            found = np.concatenate([*parts, found[last:]])
        return found.astype(np.int32), counts

    def unknown_ids(self, text: str) -> list[int]:
        if self.byte_fallback:
            return self.byte_ids[list(text.encode("utf-8", "replace"))].tolist()
        return [self.unknown]

    def viterbi(self, ids: np.ndarray) -> np.ndarray:
        """[word, start] -> the exclusive end of the piece that starts there on the best path, 0 where none starts."""
        m, n, width = ids.shape
        bpe = self.model_type == BPE
        best = np.full((m, n + 1), 0.0 if bpe else -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, n + 1), np.int64)
        ending = np.full((m, n + 1), -1, np.int32)  # the last piece of the best path to a position
        every = np.arange(m)
        for end in range(1, n + 1):
            k = np.arange(min(end, width), 0, -1)  # among equals the longest last piece, as the library has it
            piece = ids[:, end - k, k - 1]
            if bpe:
                s = np.where((piece < 0) & (k == 1)[None, :], 0.5, -1.0)  # a character without a piece stands alone
                w, j = np.nonzero((piece >= 0) & self.reachable[piece])
                s[w, j] = np.where(self.fit(ending[w, end - k[j]], piece[w, j]), k[j], -1.0)
            else:
                s = np.where(piece >= 0, self.score[piece], np.where((k == 1)[None, :], self.unknown_score, -np.inf)) + best[:, end - k]
            top = s.argmax(1)
            best[:, end], back[:, end], ending[:, end] = s[every, top], end - k[top], piece[every, top]
        ends = np.zeros((m, n), np.int64)
        at, rows = np.full(m, n), np.arange(m)
        while len(rows):
            start = back[rows, at]
            ends[rows, start] = at
            going = start > 0
            rows, at = rows[going], start[going]
        if not self.byte_fallback:  # neighbouring unknown characters are one unknown piece
            for r in np.flatnonzero((ids[:, :, 0] < 0).any(1)).tolist():
                last = -1
                for i in range(n):
                    if ends[r, i] == i + 1 and ids[r, i, 0] < 0:
                        if last >= 0:
                            ends[r, last], ends[r, i] = i + 1, 0
                        else:
                            last = i
                    elif ends[r, i]:
                        last = -1
        return ends

    def alone(self, word: str) -> list[int]:
        """The same path for one word."""
        n, bpe = len(word), self.model_type == BPE
        best, back, ending = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            for k in range(min(end, self.longest), 0, -1):
                p = self.ids.get(word[end - k : end], -1)
                if p < 0 and k > 1:
                    continue
                if bpe:
                    s = 0.5 if p < 0 else float(k) if self.reachable[p] and self.fits(ending[end - k], p) else -1.0
                else:
                    s = best[end - k] + (self.unknown_score if p < 0 else self.scores[p])
                if s > best[end]:
                    best[end], back[end], ending[end] = s, end - k, p
        spans, end = [], n
        while end:
            spans.append((back[end], end, ending[end]))
            end = back[end]
        out: list[int] = []
        for lo, hi, p in reversed(spans):
            if p < 0 and not self.byte_fallback and out and out[-1] == self.unknown:
                continue
            out += [p] if p >= 0 else self.unknown_ids(word[lo:hi])
        return out

    # -- BPE: which pieces can stand side by side

    def learn_merges(self) -> None:
        """For each piece its rank as a merge (-1 for a character) and the two pieces that are merged last in it."""
        n = len(self.pieces)
        self.level, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.reachable = np.zeros(n, bool)
        keys, made = [], []
        for p, i in self.ids.items():
            for j in range(1, len(p)):
                a, b = self.ids.get(p[:j]), self.ids.get(p[j:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(int(self.rank[i]))
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        for size, same in self.sizes.items():
            if size == 1:
                self.reachable[same] = True
                continue
            for lo in range(0, len(same), 4096):
                part = same[lo : lo + 4096]
                ids, mid = self.table(self.points(part, size)), np.zeros(len(part), np.int64)
                whole = self.merge(ids, mid)[:, 0] == size
                rows = np.flatnonzero(whole)
                self.reachable[part[whole]] = True
                self.level[part[whole]] = self.rank[part[whole]]
                self.left[part[whole]] = ids[rows, 0, mid[rows] - 1]
                self.right[part[whole]] = ids[rows, mid[rows], size - mid[rows] - 1]

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces a and b side by side; -1 in a stands for no piece."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero(a >= 0)
        key = a[at].astype(np.int64) << 32 | b[at].astype(np.int64)
        slot = (key.astype(np.uint64) * BASE >> np.uint64(46)).astype(np.int64)
        hit = self.fit_keys[slot] == key
        out[at[hit]] = self.fit_values[slot[hit]]
        if not hit.all():
            new, where = np.unique(key[~hit], return_inverse=True)
            value = self.unmerge(new >> 32, new & 0xFFFFFFFF)
            out[at[~hit]] = value[where]
            slot = (new.astype(np.uint64) * BASE >> np.uint64(46)).astype(np.int64)
            self.fit_keys[slot], self.fit_values[slot] = new, value
        return out

    def unmerge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        rows, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40)
        while len(rows):
            key = a << 32 | b
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[i] == key, self.pair_ranks[i], 1 << 40) if len(self.pair_keys) else np.full(len(rows), 1 << 40)
            la, lb = self.level[a], self.level[b]
            sound = across >= limit
            sound[limit == 1 << 40] = across[limit == 1 << 40] == 1 << 40
            done = sound & (la < 0) & (lb < 0)
            out[rows[done]] = True
            going = sound & ~done
            rows, a, b, la, lb = rows[going], a[going], b[going], la[going], lb[going]
            first = la > lb  # the merge that came last is undone; of equal ones, that on the right
            limit = np.where(first, la, lb + 1)
            a, b = np.where(first, self.right[a], a).astype(np.int64), np.where(first, b, self.left[b]).astype(np.int64)
        return out

    def fits(self, a: int, b: int) -> bool:
        """fit() of one pair."""
        if a < 0:
            return True
        key = a << 32 | b
        slot = (key * int(BASE) & (1 << 64) - 1) >> 46
        if self.fit_keys[slot] != key:
            self.fit_values[slot] = self.unmerge(np.array([a]), np.array([b]))[0]
            self.fit_keys[slot] = key
        return bool(self.fit_values[slot])

    def merge(self, ids: np.ndarray, mids: np.ndarray | None = None) -> np.ndarray:
        """As viterbi(), by merging the best pair of each word again and again; mids gets the place of a last merge."""
        m, n, width = ids.shape
        ends = np.tile(np.arange(1, n + 1), (m, 1))
        if n == 1:
            return ends
        none = np.int64(1 << 40)
        rank = np.where(ids >= 0, self.rank[ids], none)
        # cost[w, i]: the rank of the pair whose first symbol starts at i
        cost = np.full((m, n), none)
        cost[:, : n - 1] = rank[:, : n - 1, 1] if width > 1 else none
        before = np.tile(np.arange(-1, n - 1), (m, 1))  # start of the symbol before
        rows = np.arange(m)
        while len(rows):
            at = cost[rows].argmin(1)
            ok = cost[rows, at] < none
            rows, at = rows[ok], at[ok]
            if not len(rows):
                break
            mid = ends[rows, at]  # the second symbol's start
            end = ends[rows, mid]
            if mids is not None:
                last = (at == 0) & (end == n)
                mids[rows[last]] = mid[last]
            ends[rows, at], ends[rows, mid], cost[rows, mid] = end, 0, none
            inner = end < n
            before[rows[inner], end[inner]] = at[inner]
            self._price(rank, ends, cost, rows, at, n, width, none)
            prev = before[rows, at]
            has = prev >= 0
            self._price(rank, ends, cost, rows[has], prev[has], n, width, none)
        return ends

    @staticmethod
    def _price(rank, ends, cost, rows, at, n, width, none) -> None:
        mid = ends[rows, at]
        inner = mid < n
        cost[rows, at] = none
        rows, at, mid = rows[inner], at[inner], mid[inner]
        length = ends[rows, mid] - at
        cost[rows, at] = np.where(length <= width, rank[rows, at, np.minimum(length, width) - 1], none)

    # -- texts

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end; words met before are kept."""
        if self.held > CACHE_BYTES:
            self.forget()
        words: list[str] = []
        stops = [0]
        for t in texts:
            if t:
                words += self.words(t)
            stops.append(len(words))
        distinct = dict.fromkeys(words)
        new = [w for w in distinct if w not in self.places]
        if new:
            order, flat, counts = self.encode_words(new)
            first = len(self.places)
            self.places.update(zip(order, range(first, first + len(order)), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
            self.held += sum(map(len, new)) + 120 * len(new) + flat.nbytes  # a string and its entry in the dictionary
        place = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
        here = dict(zip(distinct, range(len(distinct)), strict=True))  # smaller than all places, so it stays in the CPU's caches
        at = place[np.fromiter(map(here.__getitem__, words), np.int64, len(words))]
        lo = self.begin[at]
        n = self.begin[at + 1] - lo
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(lo - stop[:-1], n) + np.arange(stop[-1])]
        return ids, stop[np.array(stops)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of every text."""
        ids, at = self.encode_flat(texts)
        return [None if t is None else ids[at[i] : at[i + 1]] for i, t in enumerate(texts)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: spaces restored, byte pieces joined as UTF-8, the dummy prefix dropped."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    def plain(self, text: str) -> str:
        """What decoding an encoded text must give."""
        text = text.replace(META, " ")
        return re.sub(" +", " ", text.strip(" ")) if self.trim else text


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * BASE
    return h ^ (h >> np.uint64(29))


def load(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file's bytes: by Spark's reader if it is a URI, else from the machine that drives."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


_models: dict[int, PieceModel] = {}


def shared(spark: SparkSession, path: str = MODEL):
    """The model as a broadcast (a vocabulary and its tables, under 20 MB), built once on the driver."""
    data = load(spark, path)
    if hash(data) not in _models:
        _models.clear()
        _models[hash(data)] = PieceModel(data)
    return spark.sparkContext.broadcast(_models[hash(data)])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens and whether decoding gives the text back, for docs (doc_id, text)."""
    return _encode(docs, path, True)


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """As encode(), with a 64-bit digest of the ids in their place."""
    return _encode(docs, path, False)


def _encode(docs: DataFrame, path: str, whole: bool) -> DataFrame:
    held = shared(docs.sparkSession, path)

    def make():
        model = held.value
        is_byte = np.array([k == BYTE for k in model.kinds])

        def step(texts):
            import xxhash

            found = model.encode(texts)
            out = {
                "n_tokens": [0 if x is None else len(x) for x in found],
                "n_byte_tokens": [0 if x is None else int(is_byte[x].sum()) for x in found],
                "round_trip": [None if x is None else model.decode(x) == model.plain(t) for x, t in zip(found, texts, strict=True)],
            }
            if whole:
                out["ids"] = found
            else:
                out["ids_digest"] = [None if x is None else f"{xxhash.xxh64_intdigest(x.tobytes()):016x}" for x in found]
            return out

        step.done = model.forget
        return step

    kind = "ids array<int>" if whole else "ids_digest string"
    return map_text(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long", f"{kind}, n_tokens int, n_byte_tokens int, round_trip boolean")

