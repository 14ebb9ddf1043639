"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A boundary of the final segmentation splits a text into parts that merge independently, so tokens can be emitted from
the left as soon as no text to come can change them.  ``MergeList.lookahead`` is the number of symbols after which that
holds, computed from the merge list alone (see there).  The encoder keeps at most ``window`` symbols of a pre-token.

Every pre-token goes through the transducer; its end is a boundary, so one shorter than the window is emitted when it
closes.  Results of short pre-tokens are kept in a bounded table per task.

Texts: null counts as empty; an empty text has no tokens.  Repeated rows give repeated results; an empty table gives an
empty result; no two merges have one rank, so there are no ties.  Long pre-tokens are emitted in constant memory.  Columns
of the input pass through, but those with the name of a result give way to it.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Pre-tokens of at most so many characters are remembered, at most so many of them, twice (lately used, and before).
REMEMBER_CHARS, REMEMBER = 40, 110_000
#: From so many pairs on a heap is faster than a list; both make the same merges.
HEAP = 48
#: Texts are normalised in stretches of about so many characters, cut before a space.
STRETCH = 1 << 16


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeList:
    """A word-end BPE vocabulary: symbols, ranked merges, and the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.surface_bytes = {i: t.encode() for i, t in self.surface.items()}
        self.id_text = {i: str(i) for i in self.surface}
        self.byte_char = byte_alphabet()
        self.char_byte = {c: b for b, c in self.byte_char.items()}
        self.first = [self.ids[self.byte_char[b]] for b in range(256)]
        self.last = [self.ids[self.byte_char[b] + self.end] for b in range(256)]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.new, self.none = [self.ids[a + b] for a, b in pairs], len(pairs)
        self.size = {i: (len(t) - len(self.end) if self.end and t.endswith(self.end) else len(t)) for t, i in self.ids.items()}
        self.lookahead = self._lookahead()
        self.window = 2 * self.lookahead + 2 * max(self.size.values())

    def _lookahead(self) -> int:
        """Symbols past a boundary that decide whether a merge ever crosses it.

        ``reach[t]``: how far beyond the end of a token t in place the events of lower rank that make or consume it can
        look.  A merge (x, y) happens iff x and y are in place at its rank, so it looks as far as y does, or as x does
        less the size of y; consuming x it looks size(y) further, as seen from the end of x.  Ranks ascend, so one pass
        suffices.  It needs every token to be made before it is used, which holds for a trained list and is checked.
        """
        reach: dict[int, int] = {}
        made = set(self.first) | set(self.last)
        most = 0
        for (x, y), r in sorted(self.rank.items(), key=lambda kv: kv[1]):
            xy = self.new[r]
            if x not in made or y not in made:
                raise ValueError("a merge uses a token that no earlier merge makes")
            far = max(0, reach.get(y, 0), reach.get(x, 0) - self.size[y])
            most = max(most, self.size[y] + far)
            reach[x] = max(reach.get(x, 0), self.size[y] + far)
            reach[y] = max(reach.get(y, 0), far)
            reach[xy] = max(reach.get(xy, 0), far)
            made.add(xy)
        return most

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges, lowest rank first and leftmost among equals."""
        rank, new, none = self.rank.get, self.new, self.none
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        if len(ranks) > HEAP:
            return self._merged_by_heap(symbols, ranks)
        while ranks and (low := min(ranks)) != none:
            at = ranks.index(low)
            symbols[at : at + 2] = [new[low]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), none)
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), none)
        return symbols

    def _merged_by_heap(self, symbols: list[int], ranks: list[int]) -> list[int]:
        """The same in n log n: a heap of (rank, place) and a list linked both ways; stale entries are skipped."""
        rank, new, none = self.rank.get, self.new, self.none
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [*ranks, none]
        heap = [(r, i) for i, r in enumerate(ranks) if r != none]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            j = after[i]
            symbols[i], now[j], symbols[j] = new[r], none, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            now[i] = rank((symbols[i], symbols[k]), none) if k < n else none
            if now[i] != none:
                heapq.heappush(heap, (now[i], i))
            h = before[i]
            if h >= 0:
                now[h] = rank((symbols[h], symbols[i]), none)
                if now[h] != none:
                    heapq.heappush(heap, (now[h], h))
        return [x for x in symbols if x >= 0]


class Transducer:
    """Encodes one pre-token fed in pieces of bytes; yields ids as soon as they are stable."""

    def __init__(self, merges: MergeList):
        self.m, self.held = merges, bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        m = self.m
        for lo in range(0, len(data), m.window):
            self.held += data[lo : lo + m.window]
            while len(self.held) > m.window:  # more is held than decides what is stable
                part = self.held[: m.window]
                stable, at = m.window - m.lookahead, 0
                for t in m.merged([m.first[b] for b in part]):
                    if at + m.size[t] > stable:
                        break
                    at += m.size[t]
                    yield t
                del self.held[:at]

    def close(self) -> list[int]:
        m, held = self.m, self.held
        if not held:
            return []
        symbols = [m.first[b] for b in held]
        symbols[-1] = m.last[held[-1]]
        self.held = bytearray()
        return m.merged(symbols)


class TextDecoder:
    """Incremental decoder: ids in, text out, a character as soon as its bytes are complete.

    ``surfaces``: the vocabulary's own strings, one space between tokens.  Otherwise bytes behind the stand-ins, a word
    end becoming a space; bytes that form no character become U+FFFD.
    """

    def __init__(self, merges: MergeList, surfaces: bool = True):
        self.m, self.surfaces, self.started = merges, surfaces, False
        self.byte = merges.char_byte
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, *tokens: int) -> str:
        if self.surfaces:
            return self.feed_bytes(b" ".join([self.m.surface_bytes[t] for t in tokens])) if tokens else ""
        return self.machine.decode(b"".join(map(self._bytes, tokens)))

    def feed_bytes(self, data: bytes) -> str:
        """Surfaces that the caller has joined."""
        data, self.started = (b" " + data if self.started else data), True
        return self.machine.decode(data)

    def _bytes(self, token: int) -> bytes:
        t, end = self.m.surface[token], self.m.end
        if t in self.m.special:
            return t.encode()
        ends = bool(end) and t.endswith(end)
        return bytes(self.byte[c] for c in (t[: -len(end)] if ends else t)) + b" " * ends

    def close(self) -> str:
        return self.machine.decode(b"", True)


class Codec:
    """Normalises, splits and encodes whole texts as the vocabulary file says; keeps bounded state."""

    def __init__(self, path: str):
        import regex

        self.m = MergeList(path)
        #: Fixed value: the vocabulary file's pattern of pre-tokens.  White space only separates, so it stays as it is.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True))) + ")") if self.m.special else None
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.before: dict[str, tuple[int, str, bytes]] = {}

    def blocks(self, text: str) -> Iterator[list[str] | int]:
        """Pre-tokens in order, a list for each stretch; a special token's own string gives its id."""
        for part in self.splits.split(text) if self.splits and any(s in text for s in self.m.special) else [text]:
            if part in self.m.special:
                yield self.m.special[part]
                continue
            lo = 0
            while lo < len(part):
                hi = len(part) if len(part) - lo <= STRETCH else part.find(" ", lo + STRETCH)
                hi = len(part) if hi < 0 else hi
                s = part[lo:hi]
                s = s.lower() if s.isascii() else unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()
                yield self.pattern.findall(s)
                lo = hi

    def ids(self, word: str) -> Iterator[int]:
        """One pre-token through the transducer."""
        t = Transducer(self.m)
        yield from t.feed(word.encode())
        yield from t.close()

    def entry(self, word: str) -> tuple[int, str, bytes]:
        """(number of ids, ids as text, bytes of the tokens' strings) of a pre-token."""
        out = self.before.get(word)
        if out is None:
            m, ids = self.m, list(self.ids(word))
            out = (len(ids), " ".join([m.id_text[t] for t in ids]), b" ".join([m.surface_bytes[t] for t in ids]))
        if len(word) <= REMEMBER_CHARS:
            if len(self.known) >= REMEMBER:
                self.before = dict(self.known)
                self.known.clear()
            self.known[word] = out
        return out

    def stream(self, text: str) -> Iterator[list[tuple[int, str, bytes]]]:
        """Entries in order, in lists; the ids of a giant pre-token one by one as they become stable."""
        get, entry, m = self.known.get, self.entry, self.m
        single = lambda t: [(1, str(t), m.surface_bytes[t])]
        for block in self.blocks(text):
            if isinstance(block, int):
                yield single(block)
            elif block and len(block) * 100 < STRETCH and max(map(len, block)) > STRETCH:
                for w in block:
                    yield from map(single, self.ids(w)) if len(w) > STRETCH else ([entry(w)],)
            elif block:
                yield [get(w) or entry(w) for w in block]

    def encode(self, text: str) -> list[int]:
        return [int(t) for entries in self.stream(text) for e in entries for t in e[1].split()]

    def digest(self, text: str, with_ids: bool = False) -> tuple:
        """(number of tokens, SHA-256 of the ids as text, SHA-256 of the decoded text[, ids])."""
        n, kept, sep = 0, [], ""
        h, d, decoder = hashlib.sha256(), hashlib.sha256(), TextDecoder(self.m)
        for entries in self.stream(text):
            n += sum([e[0] for e in entries])
            ids = " ".join([e[1] for e in entries])
            h.update((sep + ids).encode())
            d.update(decoder.feed_bytes(b" ".join([e[2] for e in entries])).encode())
            sep = " "
            if with_ids:
                kept += map(int, ids.split())
        d.update(decoder.close().encode())
        return (n, h.hexdigest(), d.hexdigest(), kept) if with_ids else (n, h.hexdigest(), d.hexdigest())


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` but ``text``, and n_tokens, ids_sha256, decoded_sha256[, token_ids]; no shuffle."""
    from .common import each_text

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def work():
        codec = codec_of(path)
        return lambda text: codec.digest(text, with_ids)

    return each_text(docs, work, fields)
