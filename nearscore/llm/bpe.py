"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text machine.

Merges run in rank order. How far to the left can text that is still unread change the merges? A difference moves
its edge to the left only where a rule (u, v) applies across the edge with one continuation and not with another;
the edge then lies len(u) further left, and what stands right of it starts with u there, in either case. So the next
rule (u2, v2) that moves the edge has a later rank, and u is on the left spine of v2: v2 itself, the left part of
the rule that makes v2, and so on. The largest sum of len(u) over such chains of rules, found in one pass through
the merge list, is its sufficient lookahead: tokens that end at least that many symbols before the end of what has
been read are final. The transducer holds a block of symbols, merges it, emits the tokens that are final and goes on
with the rest, so its memory is constant whatever the length of a word. (Spark hands over whole texts, so a task holds the
text that it reads; what is kept besides is a block of it, the ids of one block, and the caches.) The bound needs a proper list (each token is made by
one rule, from tokens that earlier rules make); this is checked when the list is read.

Words of ordinary length are merged in one block and remembered in two bounded generations of a cache.

Normalisation and word splitting follow the tokenizer's file. For texts of plain characters (ASCII, Latin letters,
common punctuation) they are done here; any other text goes block by block through the library's own normaliser and
pre-tokeniser, and only the merges are ours. Strings of special tokens in a text are their tokens, as in the library.

Cases: null text is empty text (no tokens, empty decoded text); very long texts are read in blocks cut at white
space, or where there is none for a block, at the next one; ids that the vocabulary lacks are skipped when decoding; there
are no ties (a rank has one rule); repeated rows give repeated results, an empty table none; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

BLOCK_CHARS = 1 << 20
#: Words in each of two generations of the cache, at some 150 bytes a word: 20 MB a process.
CACHE_WORDS = 1 << 16
WORD_SYMBOLS = 256

#: Characters for which lower(), one white space class and the word pattern below agree with the library's rules.
_PLAIN = re.compile("[\t\n\r -~¡«»¿À-ÖØ-öø-ÿĀ-įı-ňŊ-ž‘’“”–—…]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿĀ-ž]+|[0-9]|[^\\s0-9a-zß-öø-ÿĀ-ž]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    own = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


class Merges:
    """A merge list with its sufficient lookahead; merges sequences of symbol ids."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[str, tuple[str, str]] = {}
        self.proper = True
        best: dict[str, int] = {}
        spine: dict[str, int] = {}
        self.lookahead = 0
        for rank, (u, v) in enumerate(merges):
            token = u + v if not suffix else u.removesuffix(suffix) + v
            self.rules[vocab[u], vocab[v]] = (rank, vocab[token])
            self.proper &= token not in made
            made[token] = (u, v)
            reach, t = 0, v
            while True:
                reach = max(reach, best.get(t, 0))
                if t not in made:
                    break
                t = made[t][0]
            length = len(u.removesuffix(suffix)) + reach
            best[u] = max(best.get(u, 0), length)
            self.lookahead = max(self.lookahead, length)
        # pairs as one number and tokens by rank, for the short path of merge()
        self._size = max(vocab.values()) + 1
        self._rank = {u * self._size + v: rank for (u, v), (rank, _) in self.rules.items()}
        self._made = dict(self.rules.values())
        self._none = 1 << 60
        order = {t: i for i, t in enumerate(made)}
        self.proper &= all(order.get(x, -1) < i for i, (t, uv) in enumerate(made.items()) for x in uv)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one block, lowest rank first and from the left."""
        rules, n = self.rules, len(ids)
        if n < 2:
            return ids
        if n <= 64:
            get, none, made, size = self._rank.get, self._none, self._made, self._size
            ranks = [get(a * size + b, none) for a, b in zip(ids, ids[1:])]
            while (low := min(ranks)) != none:
                at, token = ranks.index(low), made[low]
                ids[at] = token
                del ids[at + 1], ranks[at]
                if at:
                    ranks[at - 1] = get(ids[at - 1] * size + token, none)
                if at < len(ranks):
                    ranks[at] = get(token * size + ids[at + 1], none)
                elif not ranks:
                    break
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        ids = [*ids, -1]
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], k = rules[a, b][1], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if r := rules.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rules.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids[:n] if x >= 0]

    def stream(self, symbols: Iterable[int], length: dict[int, int], block: int = 1024) -> Iterator[int]:
        """Tokens of any number of symbols, each emitted once it is final. length: of tokens, in symbols."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if self.proper and len(held) >= block + self.lookahead:
                final, done = len(held) - self.lookahead, 0
                for t in self.merge(held.copy()):
                    if done + length[t] > final:
                        break
                    yield t
                    done += length[t]
                held = held[done:]
        yield from self.merge(held)


class Decoder:
    """Bytes to text, a piece at a time: holds an unfinished character until its last byte; bad bytes become U+FFFD."""

    def __init__(self) -> None:
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, piece: bytes, last: bool = False) -> str:
        return self._machine.decode(piece, last)


class _Words(dict):
    """Ids of words; those that are not there are made, and remembered by the maker."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, word: str) -> bytes:
        return self._make(word)


class Bpe:
    """A tokenizer read from a file of the tokenizers library (BPE on bytes, words split beforehand)."""

    def __init__(self, path: str, library_merges: bool = False):
        from tokenizers import Tokenizer

        self._cache_words = CACHE_WORDS

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model = conf["model"]
        kinds = [x["type"] for x in (conf["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in conf["pre_tokenizer"].get("pretokenizers", [])]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or conf["decoder"] or model["byte_fallback"]:
            raise ValueError(f"{path}: this kind of tokenizer is not supported")
        library = Tokenizer.from_file(path)
        self._normalizer, self._splitter = library.normalizer, library.pre_tokenizer
        self._model = library.model if library_merges else None
        vocab, self._suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(vocab, pairs, self._suffix)
        self._first = {c: vocab[c] for c in byte_symbols()}
        self._last = {c: vocab[c + self._suffix] for c in byte_symbols()}
        self._table = dict(enumerate(byte_symbols()))
        self._length = {i: len(t.removesuffix(self._suffix)) for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self._special = {t: i for t, i in special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        surface: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self._surface = [surface.get(i, "").encode() for i in range(max(surface) + 1)]
        self._known = [i in surface for i in range(max(surface) + 1)]
        self._new, self._old = _Words(self._word), _Words(self._word)
        self._pieces: dict[str, bytes] = {}

    # encoding

    def _symbols(self, piece: str) -> Iterator[int]:
        for c in piece[:-1]:
            yield self._first[c]
        yield self._last[piece[-1]]

    def _short(self, piece: str) -> bytes:
        """Ids (little-endian, 32 bits) of a pre-token of at most WORD_SYMBOLS bytes, given in byte symbols."""
        if self._model:
            return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()
        ids = [*map(self._first.__getitem__, piece)]
        ids[-1] = self._last[piece[-1]]
        return array("I", self.merges.merge(ids)).tobytes()

    def _piece(self, piece: str) -> Iterator[bytes]:
        """Ids of a pre-token of any length, given in byte symbols."""
        if len(piece) <= WORD_SYMBOLS:
            if (ids := self._pieces.get(piece)) is None:
                if len(self._pieces) >= self._cache_words // 4:
                    self._pieces.clear()
                ids = self._short(piece)
                if len(piece) <= 40:
                    self._pieces[piece] = ids
            yield ids
            return
        out = array("I")
        for t in self.merges.stream(self._symbols(piece), self._length):
            out.append(t)
            if len(out) == 1 << 16:
                yield out.tobytes()
                out = array("I")
        yield out.tobytes()

    def _word(self, word: str) -> bytes:
        """Of a word without white space, through both generations of the cache."""
        if (ids := self._old.get(word) or self._new.get(word)) is None:
            parts = _WORD.findall(word) if not word.isalpha() else [word]
            if len(parts) == 1:
                piece = word if word.isascii() else self._as_symbols(word)
                ids = self._short(piece) if len(piece) <= WORD_SYMBOLS else b"".join(self._piece(piece))
            else:
                out = []
                for m in parts:
                    known = self._new.get(m) or self._old.get(m)
                    out.extend([known] if known else self._piece(self._as_symbols(m)))
                ids = b"".join(out)
        if len(word) <= 40:
            if len(self._new) >= self._cache_words:
                self._old, self._new = self._new, _Words(self._word)
            self._new[word] = ids
        return ids

    def _as_symbols(self, s: str) -> str:
        return s if s.isascii() else s.encode().decode("latin-1").translate(self._table)

    def _section(self, text: str) -> Iterator[bytes]:
        """Of text without special tokens, in blocks cut before white space, where no rule looks across."""
        at, n = 0, len(text)
        while at < n:
            end = min(n, at + BLOCK_CHARS)
            if end < n:
                gap = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                while gap > at and text[gap - 1] in " \n":
                    gap -= 1
                if gap > at:
                    end = gap
                else:
                    more = re.compile("[ \n]").search(text, end)
                    end = more.start() if more else n
            block, at = text[at:end], end
            if _PLAIN.fullmatch(block):
                yield b"".join(map(self._new.__getitem__, block.lower().split()))
            else:
                for piece, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(block)):
                    yield from self._piece(piece)

    def encode_pieces(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, a piece at a time."""
        if not text:
            return
        for k, part in enumerate(self._cut.split(text) if self._cut else [text]):
            if k % 2:
                yield array("I", [self._special[part]]).tobytes()
            elif part:
                yield from self._section(part)

    def encode(self, text: str | None) -> list[int]:
        return array("I", b"".join(self.encode_pieces(text))).tolist()

    # decoding

    def decode_pieces(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Text of ids given a piece at a time. The file names no decoder: tokens stand as they are, a space between."""
        machine, table, first = Decoder(), self._surface, True
        for piece in ids:
            a = array("I", piece)
            if not a:
                continue
            try:
                joined = b" ".join([table[i] for i in a])
            except IndexError:
                joined = b" ".join([table[i] for i in a if i < len(table)])
            yield machine.feed(joined if first else b" " + joined)
            first = False
        yield machine.feed(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_pieces([array("I", [i for i in ids if i < len(self._known) and self._known[i]]).tobytes()]))


_loaded: dict[tuple, Bpe] = {}


def load(path: str, library_merges: bool = False) -> Bpe:
    """One tokenizer for each file in a process, with its caches. library_merges: the library merges the words that the
    caches lack, for callers that want its ids and not the transducer."""
    if (path, library_merges) not in _loaded:
        _loaded[path, library_merges] = Bpe(path, library_merges)
    return _loaded[path, library_merges]


def digests(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids and SHA-256 of the decoded text, never holding either whole."""
    n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

    def watched() -> Iterator[bytes]:
        nonlocal n
        for piece in bpe.encode_pieces(text):
            n += len(piece) // 4
            ids.update(piece)
            yield piece

    for part in bpe.decode_pieces(watched()):
        decoded.update(part.encode())
    return n, ids.hexdigest(), decoded.hexdigest()
